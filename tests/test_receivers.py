"""Calls and callbacks by the types of their receivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygraph.operators import receivers, resolution
from quarrygraph.sources import pycode

FILES = {
    "f.py": "class Engine:\n    def start(self):\n        pass\n\n\ndef build() -> 'Engine':\n    return Engine()\n\n\nclass Car:\n    engine: Engine\n\n    def __init__(self):\n        self.spare = build()\n\n    def go(self):\n        self.engine.start()\n        self.spare.start()\n        self.other.start()\n        super().go()\n        build().start()\n",
    "bus.py": "class Line:\n    def stop(self):\n        pass\n\n\nclass Bus(Line):\n    def send(self, x):\n        pass\n\n\nbus = Bus()\n",
    "use.py": "from bus import bus\nimport bus as b\n\n\ndef ok():\n    bus.send(1)\n    bus.stop()\n\n\ndef shadowed(bus):\n    bus.send(2)\n\n\ndef rebound():\n    bus = object()\n    bus.send(3)\n\n\ndef later(x: 'b.Bus'):\n    x.send(4)\n    x = b.Line()\n    x.stop()\n    x.send(5)\n",
    "app/__init__.py": "",
    "app/made.py": "from bus import Bus\nfrom . import far\n\n\ndef factory() -> Bus:\n    return Bus()\n\n\nclass Holder:\n    def __init__(self, given: Bus, plain):\n        self.given = given\n        self.plain = plain\n        self.late = far.remote()\n\n    def run(self):\n        self.given.send(1)\n        self.plain.send(2)\n        self.late.stop()\n        y = factory()\n        y.stop()\n",
    "app/far.py": "from bus import Line\n\n\ndef remote() -> 'Line':\n    return Line()\n",
    "cb.py": "from functools import partial\n\n\ndef handler(x):\n    pass\n\n\nclass W:\n    def on(self):\n        pass\n\n    def go(self, w: 'W'):\n        reg(handler, self.on, partial(partial(handler, 1), 2), w.on, W, k=w.none, z=unknown)\n",
    "circle.py": "class A(B):\n    pass\n\n\nclass B(A):\n    def m(self):\n        self.none()\n        self.m()\n",
    "bad.py": "def (",
}


def made(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    return pycode.facts(df), resolution.modules(df)


def test_call_targets(spark):
    got = {(r.src, r.dst, r.status) for r in receivers.call_targets(*made(spark, FILES)).where("kind = 'calls' and src not like 'circle%'").collect()}
    assert got == {
        ("f.Car.__init__", "f.build", "confirmed"),
        ("f.Car.go", "f.Engine.start", "static_inferred"),
        ("f.Car.go", "f.build", "confirmed"),
        ("use.ok", "bus.Bus.send", "static_inferred"),
        ("use.ok", "bus.Line.stop", "static_inferred"),
        ("use.later", "bus.Bus.send", "static_inferred"),
        ("use.later", "bus.Line.stop", "static_inferred"),
        ("app.made.Holder.__init__", "app.far.remote", "confirmed"),
        ("app.made.Holder.run", "bus.Bus.send", "static_inferred"),
        ("app.made.Holder.run", "bus.Line.stop", "static_inferred"),
        ("app.made.Holder.run", "app.made.factory", "confirmed"),
    }
    assert receivers.call_targets(*made(spark, {"a.txt": "x"})).count() == 0


def test_methods_of_classes_that_extend_each_other(spark):
    got = {(r.src, r.dst) for r in receivers.call_targets(*made(spark, {"circle.py": FILES["circle.py"]})).collect()}
    assert got == {("circle.B.m", "circle.B.m")}


def test_callback_targets(spark):
    got = {(r.slot, r.text, r.symbol) for r in receivers.callback_targets(*made(spark, {"cb.py": FILES["cb.py"], "x.py": "import cb\ncb.reg(cb.handler)\n"})).collect()}
    assert got == {("0", "handler", "cb.handler"), ("1", "self.on", "cb.W.on"), ("2", "handler", "cb.handler"), ("3", "w.on", "cb.W.on"), ("0", "cb.handler", "cb.handler")}


def test_files_of_one_part_are_read_by_many_tasks(spark):
    files = spark.range(64, numPartitions=1).select(F.concat("id", F.lit(".py")).alias("path"), F.lit("x = f()\n").alias("text"))
    got = pycode.facts(files).where("fact = 'call'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(got) >= 4 and sum(r["count"] for r in got) == 64
