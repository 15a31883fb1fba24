"""Tags with offsets, embedded scripts and styles, templates: attributes, case, quotes, comments, and texts that close nothing."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.sources import collectors
from loomgraph.sources import markup as m


def test_a_script_with_attributes_is_kept():
    text = '<script lang="ts">let a=1</script><p>b</p>'
    assert m.script_alone(text) == " " * 18 + "let a=1" + " " * 17


def test_tags_and_their_offsets():
    text = """<a href='x>y' b = "c" d=e f><SCRIPT src=a.js data-x="</script>">\nif (a<b) "</p>"\n</ScRiPt ><style>p{}</style><!-- <script>no</script> --><script src="z"/><p id=1 id=2 class="a b">< b 1<2"""
    found = list(m.tags(text))
    assert [(t.name, t.closing, t.empty) for t in found] == [("a", False, False), ("script", False, False), ("script", True, False), ("style", False, False), ("style", True, False), ("script", False, True), ("p", False, False)]
    assert found[0].attributes == {"href": "x>y", "b": "c", "d": "e", "f": ""} and found[1].attributes["data-x"] == "</script>" and found[-1].attributes == {"id": "1", "class": "a b"}
    assert all(text[t.start] == "<" and text[t.end - 1] == ">" for t in found)
    assert all(text.startswith(v, t.places[k]) for t in found for k, v in t.attributes.items() if v)
    assert [(r.kind, text[r.start : r.end]) for r in m.regions(text)] == [("script", '\nif (a<b) "</p>"\n'), ("style", "p{}")]


def test_templates():
    svelte = "<script>let a</script>{#if x}{a + '}'} {b{c}d} {...s}{@html z}\n<style>p{m:0}</style>{ok} 'it{s}'"
    script, language, styles = m.template(svelte, "svelte")
    assert re.findall(r"\S+(?: \S+)*", script) == ["let a", "{a + '}'} {b{c}d}", "{ok}", "{s}"] and language == "javascript" and len(styles) == 1
    astro = "\n---\nconst a: X = 1\n---\n<p>{x}</p><script>b</script>"
    script, language, _ = m.template(astro, "astro")
    assert script.split() == ["const", "a:", "X", "=", "1", "b"] and language == "typescript"
    assert m.template("<SCRIPT setup LANG='TypeScript'>x</SCRIPT>{no}", "vue")[:2] == (" " * 32 + "x" + " " * 13, "typescript")
    assert m.template("---\nopen", "astro")[0] == "   \n    "


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<script", "<style", "</script>", "</style >", ">", "/>", " a=", '"', "'", "<!--", "-->", "<p>", "{", "}", "x", " ", "\n", "---\n", "é", "<"]), max_size=40))
def test_length_and_breaks_stay_whatever_the_text(parts):
    text = "".join(parts)
    for made in (m.script_alone(text), *[m.template(text, kind)[0] for kind in ("vue", "svelte", "astro")]):
        assert len(made) == len(text)
        assert all(a == b or (a == " " and b not in "\n\r") for a, b in zip(made, text))
    for r in m.regions(text):
        assert text[r.opening : r.opening + 1] == "<" and r.opening < r.start <= r.end < r.closing <= len(text)


def test_texts_that_close_nothing_take_linear_time():
    for part in ('<a "', "<script>", "{", "<!--", "<a b='", "<", "<a / ", "</script", "{'"):
        began = time.perf_counter()
        m.template(part * 60_000 + "}", "svelte")
        assert time.perf_counter() - began < 5, part
    began = time.perf_counter()
    assert len(collectors.json_keys('{"a": 1}\n' * 40_000)) == 40_000
    assert time.perf_counter() - began < 5


def test_units_of_pages(spark):
    text = '<html><body id="top"><div class="x\ny">\n<section><p id="top" class="z"><a href="/q">l</a></section>\n<link href="c.css">'
    rows = m.page_units(spark.createDataFrame([("p", text), ("none", None)], "path string, text string")).orderBy("path", "ordinal").collect()
    assert [(r.role, r.name, r.line, r.parent) for r in rows] == [("region", "region:1", 1, None), ("id", "top", 1, "region:1"), ("class", "x", 1, "region:1"), ("class", "y", 1, "region:1"), ("region", "region:3", 3, None), ("class", "z", 3, "region:3"), ("a", "/q", 3, "region:3"), ("link", "c.css", 4, "region:3")]
