"""Facts of JavaScript, C++ and robot files on small trees."""

from __future__ import annotations

from quarrygraph.sources import cppcode as C
from quarrygraph.sources import jscode as J
from quarrygraph.sources import pycode, robots, scanner

JS = {
    "web/src/app.tsx": '''import React, { useState } from "react";
import { api } from "./api/client"; // import x from "no"
import Panel from "@/ui/Panel";
export function App(props) {
  const r = await fetch(`/users/${id}`, { method: "PUT" });
  axios.get("https://api.example.com/v1/x");
  bus.emit("order:new", 1);
  bus.on("order:new", onOrder);
  button.on("click", f);
  return null;
}
const helper = (a) => { return a; };
export class Store extends Base { go() { prisma.user.findMany(); } }
''',
    "web/src/api/client/index.ts": 'const db = require("pg"); db.query("SELECT a FROM users");\nconst S = createSlice({ name: "cart" });\n',
    "src/ui/Panel.jsx": "export const Panel = () => { return 1; };\n",
    "server/main.js": 'const express = require("express");\nconst app = express();\napp.get("/users/:id", auth, users.show);\nother.get("/no", x);\napp.put("/users/:id", (req, res) => {});\n',
    "web/app/api/items/[id]/route.ts": "export async function GET(req) {}\n",
}


def test_javascript(spark):
    files = spark.createDataFrame([*JS.items(), ("x.ts", None)], "path string, text string")
    found = J.facts(files)
    rows = found.collect()
    of = lambda fact: {(r.name, r.target, r.detail) for r in rows if r.fact == fact}
    assert {(r.src, r.dst) for r in J.imports(found, files).collect()} == {("web/src/app.tsx", "web/src/api/client/index.ts"), ("web/src/app.tsx", "src/ui/Panel.jsx")}
    assert {r.package for r in J.packages(found).collect()} == {"react", "pg", "express"}
    assert of("function") == {("App", None, "ui"), ("helper", None, None), ("Panel", None, "ui"), ("GET", None, "export")} and of("class") == {("Store", "Base", "export")}
    assert {(r.method, r.route, r.handler) for r in J.routes(found).collect()} >= {("GET", "/users/{}", "users.show"), ("GET", "/api/items/{}", "GET")}
    assert not [r for r in J.routes(found).collect() if r.route == "/no"]
    assert {(r.method, r.route, r.host) for r in J.requests(found).collect()} == {("PUT", "/users/{}", None), ("GET", "/v1/x", "api.example.com")}
    assert {(n, d) for n, _, d in of("publish")} == {("order:new", "emit")} and of("subscribe") == {("order:new", "onOrder", "on")}
    assert of("data") == {("user", None, "findMany"), ("users", None, "SELECT")} and of("state") == {("cart", None, None)}
    span = next(r for r in rows if r.fact == "function" and r.name == "App")
    assert (span.line, span.end_line) == (4, 11)
    served = spark.createDataFrame([("server/main.py", "PUT", "/users/{}"), ("server/all.py", "ANY", "/users/{}")], "path string, method string, route string")
    assert {(r.client, r.server) for r in J.answered(J.requests(found), served).collect()} == {("web/src/app.tsx", "server/main.py"), ("web/src/app.tsx", "server/all.py")}
    assert J.facts(files.where("false")).count() == 0


CPP = {
    "inc/geo/shape.h": "#include <vector>\nclass API_EXPORT Shape : public Base<int> {\n public:\n  virtual double area() const { return scale(2); }\n  double scale(int k) { return k; }\n};\n",
    "src/circle.cpp": '#include "shape.h"\n#include "near.h"\nstruct Circle final : public geo::Shape { };\ndouble Circle::radius() { /* no() */ return helper(1) + s->area(); }\nstatic int helper(int a) {\n  if (a) { return Circle::radius(); }\n  return twice(1);\n}\n',
    "src/near.h": "int twice(int);\n",
    "a/dup.cpp": "void dup() { scale(1); }\n",
    "b/dup.cpp": 'void dup() { }\nint main(int argc, char** argv) { dup(); helper(2); x.helper(3); return 0; }\n',
}


def test_cpp(spark):
    files = spark.createDataFrame([*CPP.items(), ("n.cpp", None)], "path string, text string")
    found = C.facts(files)
    assert {(r.src, r.dst) for r in C.includes(found, files).collect()} == {("src/circle.cpp", "inc/geo/shape.h"), ("src/circle.cpp", "src/near.h")}
    f = C.functions(found)
    got = {r.id: (r["class"], r.entry) for r in f.collect()}
    assert got == {"fn:inc/geo/shape.h:Shape::area": ("Shape", False), "fn:inc/geo/shape.h:Shape::scale": ("Shape", False), "fn:src/circle.cpp:Circle::radius": ("Circle", False), "fn:src/circle.cpp:helper": (None, False), "fn:a/dup.cpp:dup": (None, False), "fn:b/dup.cpp:dup": (None, False), "fn:b/dup.cpp:main": (None, True)}
    assert {(r.src, r.dst) for r in C.inheritance(found).collect()} == {("cls:src/circle.cpp:Circle", "cls:inc/geo/shape.h:Shape")}
    calls = {(r.src.rpartition(":")[2], r.dst.rpartition(":")[2]) for r in C.calls(found, f).collect()}
    assert calls == {("area", "scale"), ("radius", "helper"), ("radius", "area"), ("helper", "radius"), ("main", "helper")}
    assert [r.c for r in spark.createDataFrame([("fn:a.cc:X::run",), ("fn:a.cc:run",), ("fn:a.cc:N::X::run",)], "i string").select(C.owner_class("i" if False else __import__("pyspark.sql.functions", fromlist=["col"]).col("i")).alias("c")).collect()] == ["X", None, "X"]


def test_brackets_and_comments():
    text = 'f("}", /* } */ {a: [")"]}) // {'
    assert scanner.closing(text, text.index("{")) == text.index("})") and scanner.closing("(", 0) == 1
    assert scanner.without_comments(text).count("}") == 2 and len(scanner.without_comments(text)) == len(text)


ROS = {
    "robot/talker.py": '''from rclpy.node import Node
class Talker(Node):
    def __init__(self):
        super().__init__("talker")
        self.p = self.create_publisher(String, "chatter", 10)
        self.t = self.create_timer(0.5, self.tick)
        self.declare_parameter("rate", 3)
class Other(Node):
    def __init__(self):
        super().__init__("other")
        self.s = self.create_subscription(String, "/chatter", self.on, 10)
        self.a = ActionServer(self, Fib, "fib", self.run)
''',
    "robot/go.launch.py": 'def g():\n    return [Node(package="robot", executable="talker", name="t1"), Node(package="far", executable="tool")]\n',
    "robot/x.launch": '<launch><node pkg="robot" exec="talker"/></launch>',
    "cpp/n.cpp": 'class N : public rclcpp::Node {\n N() : Node("cnode") {\n  create_publisher<std_msgs::msg::String>("out", 10);\n  t.header.frame_id = "map";\n  t.child_frame_id = "base";\n  t.header.frame_id = "base";\n  t.child_frame_id = "arm";\n }\n};\n',
}


def test_robots(spark):
    files = spark.createDataFrame(list(ROS.items()), "path string, text string")
    py, cpp = pycode.facts(files), robots.cpp_facts(files)
    nodes = robots.declared(py, cpp)
    assert {(r.path, r.name) for r in nodes.where("path not like '%launch%'").collect()} == {("robot/talker.py", "talker"), ("robot/talker.py", "other"), ("cpp/n.cpp", "cnode")}
    faces = robots.owned(robots.interfaces(py, cpp), nodes.where("path not like '%launch%'"))
    got = {(r.src, r.dst, r.kind) for r in robots.edges(faces).collect()}
    assert got == {("ros:talker", "topic:/chatter", "publishes"), ("topic:/chatter", "ros:other", "subscribes"), ("ros:other", "action:/fib", "action_provide"), ("timer:0.5", "ros:talker", "triggers"), ("ros:talker", "param:rate", "config_dependency"), ("ros:cnode", "topic:/out", "publishes")}
    assert {(r.parent, r.child) for r in robots.frames(cpp).collect()} == {("map", "base"), ("base", "arm")}
    launches = robots.launched(py, files)
    assert {(r.path, r.executable, r.name) for r in launches.collect()} == {("robot/go.launch.py", "talker", "t1"), ("robot/go.launch.py", "tool", None), ("robot/x.launch", "talker", None)}
    built = spark.createDataFrame([("robot", "talker", "robot/talker.py")], "package string, executable string, file string")
    assert {(r.path, r.node) for r in robots.started(launches, built, nodes).collect()} == {("robot/go.launch.py", "talker"), ("robot/go.launch.py", "tool"), ("robot/x.launch", "talker")}


def test_tokens():
    from quarrygraph.sources import tokens as T

    ts = T.tokens('a.b("}", x) // {\n  /* ( */ f = `t\n${1}` => {\n}')
    assert [(t.kind[0], t.text) for t in ts] == [("w", "a"), ("s", "."), ("w", "b"), ("s", "("), ("q", "}"), ("s", ","), ("w", "x"), ("s", ")"), ("w", "f"), ("s", "="), ("q", "t\n${1}"), ("s", "=>"), ("s", "{"), ("s", "}")]
    assert [ts[i].line for i in (0, 8, 11, 13)] == [1, 2, 3, 4]
    assert ts[3].mate == 7 and ts[7].mate == 3 and [t.text for t in ts if t.leads] == ["a", "f", "}"]
    open_ = T.tokens("f(( a")
    assert all(t.mate is None for t in open_) and not list(T.found("x", "f(( a", [("c", (T.word(), T.whole("(")))]))
    assert T.tokens("") == []
