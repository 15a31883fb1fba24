"""Routes by what their receivers are bound to: prefixes through mounts, shadowing, other names, strings and comments."""

from loomgraph.operators import routes


def found(spark, **texts):
    sources = spark.createDataFrame([(name.replace("_", "."), text) for name, text in texts.items()], "path string, text string")
    return sorted((r.path, r.line, r.framework, r.method, r.route, r.handler) for r in routes.routes(sources).collect())


def test_python(spark):
    text = '''from fastapi import APIRouter as R, FastAPI
import fastapi as f
"""
@app.get("/in-a-string")
"""
app = FastAPI(title="t")
inner = R(prefix="/inner")
outer = f.APIRouter(prefix='/outer')
@inner.get("/a")
def a(): ...
# @app.get("/commented")
outer.include_router(inner, prefix="/mid")
app.include_router(outer)
app.include_router(outer, prefix="/v2")
@app.post("/p")
    @app.get("/nested")
inner = something()
@inner.get("/shadowed")
other = FastApi()
@other.get("/unknown")
FastAPI = fake
late = FastAPI()
@late.get("/late")
'''
    assert found(spark, a_py=text) == sorted([("a.py", 15, "fastapi", "POST", "/p", None), ("a.py", 9, "fastapi", "GET", "/outer/mid/inner/a", None), ("a.py", 9, "fastapi", "GET", "/v2/outer/mid/inner/a", None)])


def test_scripts(spark):
    express = "import express, { Router as R } from 'express';\nconst app = express();\n/* app.get('/no', h);\n*/\nconst api: R = R();\nconst t = `\napp.get('/no', h);\n`;\napi.get(`/x`, ctl.list);\napp.use('/api', api);\nfunction f() {\n  app.get('/inner', h);\n}\napp.delete('/d', async (q) => q);\napp = wrap(app);\napp.get('/gone', h);"
    fastify = "const Fastify = require('fastify')\nconst server = Fastify({ logger: true })\nserver.get('/ping', pong)\nconst { Router: Q } = require('express')\nconst q = Q()\nq.put('/q', h)"
    assert found(spark, b_ts=express, c_js=fastify) == sorted([("b.ts", 9, "express", "GET", "/api/x", "ctl.list"), ("b.ts", 14, "express", "DELETE", "/d", None), ("c.js", 3, "fastify", "GET", "/ping", "pong"), ("c.js", 6, "express", "PUT", "/q", "h")])


def test_mounts_in_a_ring_and_empty_sources(spark):
    ring = "from fastapi import APIRouter\na = APIRouter(prefix='/a')\nb = APIRouter(prefix='/b')\na.include_router(b)\nb.include_router(a)\n@a.get('/x')"
    assert found(spark, a_py=ring, b_py="", c_txt="@a.get('/x')") == []
