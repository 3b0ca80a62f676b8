import json
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from docflow.functions import json_text as J
from docflow.operators import html, parse

FENCE = "```"


def test_strict_json(apply):
    good = ['{"a":1}', "[1, 2]", '"x"', "12", "-1.5e3", "true", '{"a":{"b":[1,{"c":null}]}}', ' {"a": 1} ', '{"a":1,"a":2}']
    bad = ['{"a":1} x', "[1,]", '{"a":01}', '{"a":1}}', "", "nul", "{'a':1}", '{"a" 1}', '{"a":1,"b":}', '1,"y":2', '{"a":"\t"}']
    assert apply(J.is_json, good) == [True] * len(good)
    assert apply(J.is_json, bad) == [False] * len(bad)


def test_loose_json_takes_single_quotes(apply):
    assert apply(J.is_loose_json, ["{'a': 1}", "[{'a': 'b'}]", "{'a': 1", "[1] x"]) == [True, True, False, False]


CASES = {
    f"Here:\n{FENCE}json\n{{\"name\": \"test\", \"value\": 123}}\n{FENCE}\n": {"name": "test", "value": 123},
    f"{FENCE}\n{{\"a\": 1}}\n{FENCE}": {"a": 1},
    f"{FENCE}python\nprint()\n{FENCE} and {FENCE}json\n{{\"b\": 2}}{FENCE}": {"b": 2},
    'The answer {"a": {"b": "c"}} is here.': {"a": {"b": "c"}},
    "no json here": None,
    "{broken: json}": None,
    # strict text fails behind the json mark, but behind the bare fence it is cut to its braces
    f"{FENCE}json\n{{\"a\": 1}} trailing\n{FENCE}": {"a": 1},
    f"{FENCE}json\nsee {{\"a\": 1}} trailing\n{FENCE}": {"a": 1},
    f"{FENCE}json\n[{{\"a\": 1}}, {{\"b\": 2}}]\n{FENCE}": None,
    f"{FENCE}json\n[{{\"a\": 1}}]\n{FENCE}": {"a": 1},
    f"{FENCE}json\n[1, 2, 3]\n{FENCE}": [1, 2, 3],
    f"{FENCE}json\n{{\"a\": 1": None,
    f"{FENCE}json\nbad\n{FENCE}\n{FENCE}json\n{{\"second\": true}}\n{FENCE}": {"second": True},
    "": None,
}


def test_first_json_of_a_response(apply):
    found = apply(J.find_json, list(CASES))
    assert [None if f is None else json.loads(f) for f in found] == list(CASES.values())


def test_first_array_of_a_response(apply):
    cases = {
        f"{FENCE}json\n[{{\"a\": 1}}, {{\"b\": 2}}]\n{FENCE}": [{"a": 1}, {"b": 2}],
        "Results: [1, 2, 3]": [1, 2, 3],
        "Just text": None,
        f"{FENCE}json\n{{\"a\": 1}}\n{FENCE}": None,
        'x {"a": [1, 2]} y': [1, 2],
        "[1, 2] and [3]": None,
    }
    found = apply(J.find_json_array, list(cases))
    assert [None if f is None else json.loads(f) for f in found] == list(cases.values())


def test_random_responses_against_a_plain_model(apply):
    rng = random.Random(7)
    pieces = [FENCE, FENCE + "json", "{", "}", "[", "]", '"a"', ":", "1", ",", " ", "\n", '{"k": 2}', "[3]", "text", "null"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)]

    def blocks(text, opener):
        out, at = [], 0
        while (start := text.find(opener, at)) >= 0:
            end = text.find(FENCE, start + len(opener))
            if end < 0:
                # no closing fence after this one, but a later opener cannot have one either
                break
            out.append(text[start + len(opener):end])
            at = end + len(FENCE)
        return out

    def model(text):
        spots = blocks(text, FENCE + "json") + blocks(text, FENCE)
        lo, hi = text.find("{"), text.rfind("}")
        if 0 <= lo < hi:
            spots.append(text[lo:hi + 1])
        for spot in map(str.strip, spots):
            lo, hi = spot.find("{"), spot.rfind("}")
            if lo > 0 and hi > lo:
                spot = spot[lo:hi + 1]
            try:
                return json.loads(spot)
            except ValueError:
                pass
        return None

    found = apply(J.find_json, texts)
    for text, got in zip(texts, found):
        want = model(text)
        if want is None:
            assert got is None or json.loads(got) is None, text
        else:
            assert got is not None and json.loads(got) == want, text


def test_box_forms(apply):
    cases = {
        "[10, 20, 100, 200]": (10, 20, 100, 200), "(50, 60, 150, 160)": (50, 60, 150, 160),
        '{"x1": 0, "y1": 0, "x2": 100, "y2": 100}': (0, 0, 100, 100), "10, 20, 30, 40": (10, 20, 30, 40),
        '{"x1": 1.9, "y1": "2", "x2": -3, "y2": true}': (1, 2, -3, 1), "[1.7, 2, 3, 4]": (1, 2, 3, 4),
        "[-1, 2, 3, 4]": (-1, 2, 3, 4), "at -5, 6, 7, 8": (5, 6, 7, 8), "not a bbox": None, "[1, 2, 3]": None,
        '{"x1": "a", "y1": 2, "x2": 3, "y2": 4}': None, "[1, 2, 3, 4, 5]": (1, 2, 3, 4),
        "": None,
    }
    got = apply(parse.read_box, list(cases))
    assert [None if b is None else tuple(b) for b in got] == list(cases.values())


def test_boxes_of_a_response(responses):
    box = '"bbox": {"x1": 0, "y1": 60, "x2": 100, "y2": 110}'
    df = responses(
        f'{FENCE}json\n[{{"label": "a", {box}}}, {{"label": "b", {box}}}]\n{FENCE}',
        '"Title": [10, 20, 200, 50]\n"Body": [10, 60, 200, 300]',
        f'{FENCE}json\n[{{"bbox_2d": [1, 2, 3, 4]}}]\n{FENCE}',
        f'{{"label": "one", {box}}}',
        '{"x1": 1, "y1": 2, "x2": 3, "y2": 4}',
        '{"a": 1}',
        f"{FENCE}json\n[]\n{FENCE}",
        "note (1, 2, 3, 4) foot: (5, 6, 7, 8)",
    )
    rows = {}
    for r in parse.parse_boxes(df).orderBy("doc_id", "box_no").collect():
        rows.setdefault(r["doc_id"], []).append((r["label"], tuple(r["bbox"]) if r["bbox"] else None))
    assert rows == {
        0: [("a", (0, 60, 100, 110)), ("b", (0, 60, 100, 110))],
        1: [("Title", (10, 20, 200, 50)), ("Body", (10, 60, 200, 300))],
        3: [("one", (0, 60, 100, 110))],
        4: [(None, (1, 2, 3, 4))],
        7: [("note (1, 2, 3, 4) foot", (5, 6, 7, 8))],
    }


def test_long_prose_without_labels_is_fast(responses):
    df = responses("word " * 60000 + "[1,2")
    assert parse.parse_boxes(df).count() == 0
    assert parse.extract_pairs(df).count() == 0


def test_fence_body(apply):
    cases = {
        f"{FENCE}json\n[1]\n{FENCE}": "[1]\n", f"pre\r\n{FENCE}json\r\n[1]": "[1]", "plain": "plain",
        f" {FENCE}json\n[1]\n{FENCE}": f" {FENCE}json\n[1]\n{FENCE}", f"{FENCE}json": "",
    }
    assert apply(parse.fence_body, list(cases)) == list(cases.values())


def test_truncated_lists(apply):
    cases = {
        f"{FENCE}json\n[{{'bbox_2d': [1, 2, 3, 4], 'label': 'x'}}]\n{FENCE}": 1,
        f"{FENCE}json\n[{{\"bbox_2d\": [1, 2, 3, 4], \"label\": \"x\"}}, {{\"bbox_2d\": [1,": 1,
        "[1, 2": 0, "{broken": None, "no list": None,
    }
    got = apply(lambda v: parse.loose_items(v), list(cases))
    assert [None if g is None else len(g) for g in got] == list(cases.values())


def test_points(responses):
    df = responses('<point x="10" y="20"/> <point  x="30"  y="40" />', "none", '<point x="-1" y="2"/>')
    got = [(r["doc_id"], r["point_no"], r["x"], r["y"]) for r in parse.parse_xml_points(df).orderBy("point_no").collect()]
    assert got == [(0, 0, 10, 20), (0, 1, 30, 40)]


def test_decoded_points(responses):
    df = responses(
        f'{FENCE}xml\n<points x1="1" y1="2" x2="3" y2="4" alt="the cat"> cats </points>\n{FENCE}',
        '<points x1="1" y1="2" alt="a"/>', '<points x1="1" y1="2" x2="5" alt="a">t</points>', "<points>", "text")
    got = [r["decoded"] for r in parse.decode_points(df).orderBy("doc_id").collect()]
    assert [tuple(p) for p in got[0]["points"]] == [("1", "2"), ("3", "4")]
    assert (got[0]["alt"], got[0]["phrase"]) == ("the cat", "cats")
    assert [tuple(p) for p in got[1]["points"]] == [("1", "2")] and got[1]["phrase"] is None
    assert [tuple(p) for p in got[2]["points"]] == [("1", "2")]
    assert got[3] is None and got[4] is None


def element_by_parser(text):
    try:
        e = ElementTree.fromstring(text)
    except (ElementTree.ParseError, TypeError, ValueError):
        return None
    points = [(e.attrib.get(f"x{n}"), e.attrib.get(f"y{n}")) for n in range(1, (len(e.attrib) - 1) // 2 + 1)]
    return points, e.attrib.get("alt"), e.text.strip() if e.text else None


def test_decoded_points_equal_an_xml_parser(responses):
    cases = [
        None, "", " ", "text", "<a/>", " <a/>\n", "<a></a>", "<a> </a>", "<a>t<b/>u</a>", "<a>t<b></a></b>", "<a/><b/>", "<a/>x", "x<a/>", "<a", "<a b/>",
        "<a b='1' b='2'/>", "<a><c b='1' b='2'/></a>", "<a alt='1 > 2'/>", "<a alt='1 < 2'/>", "<a alt=\"it's\"/>", "<a alt='a b=\"c\"'/>", "<a alt='&amp;&lt;&#65;&#x1F642;&#10;'/>",
        "<a alt='&nbsp;'/>", "<a alt='a & b'/>", "<a>a & b</a>", "<a>&#0;</a>", "<a>&#xD800;</a>", "<a>x&#x41;&gt;</a>", "<a>]]></a>", "<a><![CDATA[<b> & ]]>t</a>",
        "<![CDATA[x]]><a/>", "<!-- n --><a>x<!-- <b> -->y</a><!-- z -->", "<a><!-- -- --></a>", "<?go x?><a><?go?>t</a>", "<?xml version='1.0'?><a>t</a>",
        " <?xml version='1.0'?><a/>", "<?xml version='1.0' encoding='utf-8'?>\n<a alt='é'>日本</a>", "<?xml?><a/>", "<a alt='x\ty\r\nz'>q\r\nr\rs</a>", "<é alt='1'/>",
        "<a 1='2'/>", "<1a/>", "< a/>", "<a / >", "<a></ a>", "<a></a >", "<a\nalt = 'x' />", "<a>\x01</a>", "<a alt='x'y='z'/>", "<a xmlns='u' x1='1' y1='2'/>", "<a>🙂<b>c</b></a>",
        "<p " + " ".join(f"x{n}='{n}' y{n}='{-n}'" for n in range(1, 301)) + " alt='many'>t</p>", "<a>" + "word &amp; " * 20_000 + "</a>", "<a>" * 200 + "x" + "</a>" * 200,
    ]
    pick = random.Random(3)
    bits = ["<a", "<b", ">", "/>", "</a>", "</b>", " x1='1'", " y1=\"2\"", " alt='&lt;'", "t", " ", "&amp;", "&", "<!--c-->", "<![CDATA[d]]>", "]]>", "'"]
    cases += ["<a" + "".join(pick.choices(bits, k=pick.randrange(1, 9))) + pick.choice(["</a>", "/>", ""]) for _ in range(600)]
    inner = ["<b>", "</b>", "<b/>", "<b alt='1'/>", "t ", " ", "&amp;", "&#233;", "<!--c-->", "<![CDATA[ d<]]>", "<?n o?>", "\n"]
    cases += ["<a" + pick.choice(["", " x1='1' y1='2'", " alt='&lt;'"]) + ">" + "".join(pick.choices(inner, k=pick.randrange(6))) + "</a>" for _ in range(300)]
    got = {r["doc_id"]: r["decoded"] for r in parse.decode_points(responses(*cases)).collect()}
    found = [got[i] and ([tuple(p) for p in got[i]["points"]], got[i]["alt"], got[i]["phrase"]) for i in range(len(cases))]
    wrong = [(c, f, element_by_parser(c)) for c, f in zip(cases, found, strict=True) if f != element_by_parser(c)]
    assert not wrong, wrong[:5]
    assert 150 < sum(f is not None for f in found) < 500


def test_clean_markup(apply):
    cases = {
        '<div style="color: red; font-size: 12px;">T</div>': '<div style=" font-size: 12px;">T</div>',
        '<span style="background-color: #fff;">T</span>': '<span style="background-">T</span>',
        '<div style="">T</div>': "<div>T</div>",
        '<b style="color: red">a</b><i>x; y</i>': '<b style=" y</i>',
        "  a\n \n\nb ": "a\nb",
    }
    assert apply(parse.clean_markup, list(cases)) == list(cases.values())


def test_pairs(responses):
    df = responses(
        "Name: John\nAge: 30\nCity: NYC", "x = 100\ny = 200", '"key": "value"', '{"a": 1, "b": true, "c": null, "d": "t"}',
        "a: 1\na: 2", "k:\n  v\nz: 1", ": no key\n=\n", "nothing")
    got = {}
    for r in parse.extract_pairs(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], {})[r["key"]] = r["value"]
    assert got == {
        0: {"Name": "John", "Age": "30", "City": "NYC"}, 1: {"x": "100", "y": "200"}, 2: {"key": "value"},
        3: {"a": "1", "b": "True", "c": "None", "d": "t"}, 4: {"a": "1"}, 5: {"k": "v", "z": "1"},
    }


def test_random_pairs_against_a_plain_model(responses):
    import re

    rng = random.Random(3)
    pieces = ["a", "b c", ":", "=", "\n", " ", '"', "1", ", "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(300)]
    quoted, plain = re.compile(r'"([^"]+)"\s*:\s*"([^"]*)"'), re.compile(r"([^:\n=]+)\s*[:=]\s*([^\n]+)")
    want = {}
    for i, text in enumerate(texts):
        for k, v in quoted.findall(text) + plain.findall(text):
            k, v = k.strip().strip('"'), v.strip().strip('"')
            if k:
                want.setdefault((i, k), v)
    got = {(r["doc_id"], r["key"]): r["value"] for r in parse.extract_pairs(responses(*texts)).collect()}
    assert got == want


def test_clean_response(responses):
    df = responses("<|im_start|>assistant\nhi there<|im_end|>", "  plain ", "a <|im_start|>user b")
    assert [r["text"] for r in parse.clean_response(df).orderBy("doc_id").collect()] == ["hi there", "plain", "ab"]


def test_tool_calls(spark):
    call = '<tool_call>\n{"name": "%s", "arguments": {"action": "%s", "coordinate": [10, 20]}}\n</tool_call>'
    df = spark.createDataFrame(
        [(0, call % ("computer_use", "left_click"), "computer"), (1, call % ("mobile_use", "left_click"), "mobile"),
         (2, call % ("mobile_use", "click"), "mobile"), (3, "no call", "mobile")], "doc_id int, text string, device string")
    got = parse.parse_tool_calls(df).orderBy("doc_id").collect()
    assert [r["is_click"] for r in got] == [True, False, True, False]
    assert got[0]["coordinate"] == [10.0, 20.0] and got[3]["name"] is None
    steps = spark.createDataFrame([(1, 'Done: Step 1: {"name": "m", "arguments": {"action": "open"}}; Step 2: {"name": "n", "arguments": {"action": "tap"}}; ')], "doc_id int, text string")
    assert [(r["step"], r["name"], r["action"]) for r in parse.prior_steps(steps).orderBy("step").collect()] == [(1, "m", "open"), (2, "n", "tap")]


PAGE = """<html><body>
<p style="color: red" data-bbox="1 2 3 4">A &amp; b</p>
text dropped
<div class="image caption" data-polygon="x"><img src="a"><b>c</b></div>
<div class="formula.handwritten formula" style="color:red;font-size:2px;">x</div>
<div class="music sheet" format="abc">notes</div><span class="big chart" format="f">z</span>
<ol data-bbox="9 9 9 9"><li data-bbox="30 10 20 40"> one <b>two </b></li></ol><!-- c --><br>
</body></html>"""


def test_document_markup():
    assert html.clean_page(PAGE) == (
        "```html\n<html><body>\n<p>A &amp; b</p>\n"
        '<div class="image"></div>\n'
        '<div class="formula" style="font-size:2px">x</div>\n'
        '<div class="music sheet"></div>\n<span class="big chart"></span>\n'
        "<ol><li> one <b>two </b></li></ol>\n<br/>\n</body></html>\n```")
    assert html.clean_page("<p>no body</p>") is None and html.clean_page(None) is None


def test_html_boxes(spark):
    df = spark.createDataFrame([(1, PAGE, 500, 400, 1000, 200), (2, "<p>none</p>", 1, 1, 1, 1)],
                               "page_id int, html string, resized_w int, resized_h int, width int, height int")
    got = [(r["tag"], r["text"], tuple(r["bbox"])) for r in html.html_boxes(df).orderBy("element_no").collect()]
    assert got == [("p", "A & b", (2, 1, 6, 2)), ("li", "onetwo", (40, 5, 60, 20))]


@pytest.mark.parametrize("n", [0, 1])
def test_clean_html_column(spark, n):
    df = spark.createDataFrame([("<a>",)] * n, "html string")
    assert parse.clean_html(df).count() == n
    assert html.clean_document_html(df).where(F.col("cleaned").isNull()).count() == n
