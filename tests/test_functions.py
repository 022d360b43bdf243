"""Version order, the scope algebra, quantities, cues, names and the shapes of sources."""

import io
import itertools
import zipfile

import pytest
from attestor.functions import quantity, scope
from attestor.functions.version import version_key
from attestor.functions.workers import prepare
from attestor.operators import mentions
from attestor.operators.cues import cues_of
from attestor.sources import markup
from attestor.sources.files import files
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def test_version_order(spark):
    got = spark.createDataFrame([(v,) for v in ("3.2", "3.2.0", "3.2.1", "3.10", "x.1", None)], "v string").select("v", F.expr(version_key("v")).alias("k")).collect()
    k = {r["v"]: r["k"] for r in got}
    assert k["3.2"] == k["3.2.0"] < k["3.2.1"] < k["3.10"] and k["x.1"] is None and k[None] is None


DIMS = {"any": ("any", None, None, True, False), "unknown": ("unknown", None, None, True, False), "ge3.2": ("ver", "3.2", None, True, False), "lt3.2": ("ver", None, "3.2", True, False), "eq3.2.1": ("ver", "3.2.1", "3.2.1", True, True), "3.0-3.1": ("ver", "3.0", "3.1", True, True), "eq3.10": ("ver", "3.10", "3.10", True, True)}
PAIRS_THAT_MEET = {("ge3.2", "eq3.2.1"), ("ge3.2", "eq3.10"), ("lt3.2", "3.0-3.1")}


def test_scope_relation_is_symmetric_and_unknown_is_not_any(spark):
    rows = [(a, b, *DIMS[a], *DIMS[b]) for a, b in itertools.product(DIMS, DIMS)]
    cols = [f"{p}{c}" for p in ("a_", "b_") for c in ("rev_kind string", "rev_lo string", "rev_hi string", "rev_lo_inc boolean", "rev_hi_inc boolean")]
    df = spark.createDataFrame(rows, "a string, b string, " + ", ".join(cols))
    for p in ("a_", "b_"):
        df = df.withColumn(f"{p}lo_k", F.expr(version_key(f"{p}rev_lo"))).withColumn(f"{p}hi_k", F.expr(version_key(f"{p}rev_hi")))
    got = {(r["a"], r["b"]): (r["rel"], r["met"], r["wider"]) for r in df.select("a", "b", F.expr(scope.rev_relation("a_", "b_")).alias("rel"), F.expr(scope.meet("a_", "b_")).alias("met"), F.expr(scope.contains_strictly("a_", "b_")).alias("wider")).collect()}
    for a, b in itertools.product(DIMS, DIMS):
        rel, met, wider = got[a, b]
        if "unknown" in (a, b):
            want = "UNKNOWN"
        elif "any" in (a, b) or a == b or (a, b) in PAIRS_THAT_MEET or (b, a) in PAIRS_THAT_MEET:
            want = "OVERLAP"
        else:
            want = "DISJOINT"
        assert rel == want == got[b, a][0], (a, b)
        assert (met is None) == (rel == "DISJOINT")
        if a == "any" and b != "unknown":
            assert met["kind"] == DIMS[b][0] and (met["lo"], met["hi"]) == DIMS[b][1:3]
    assert got["ge3.2", "eq3.10"][2] and not got["eq3.10", "ge3.2"][2] and got["any", "unknown"][2] and not got["any", "any"][2] and got["lt3.2", "3.0-3.1"][2]
    assert got["ge3.2", "eq3.2.1"][1]["lo"] == "3.2.1"


def test_separation_wins_over_unknown(spark):
    one = spark.sql(f"SELECT {scope.combine(repr('UNKNOWN'), repr('DISJOINT'))} AS a, {scope.combine(repr('OVERLAP'), repr('UNKNOWN'))} AS b, {scope.combine(repr('OVERLAP'), repr('OVERLAP'))} AS c").first()
    assert tuple(one) == ("DISJOINT", "UNKNOWN", "OVERLAP")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("On revisions prior to 3.2, normal discharge pressure was 180 bar", [(None, "3.2")]), ("Normal HPU discharge pressure is 200 bar on software revision 3.2 and later.", [("3.2", None)]), ("Effective software revision 3.2, pressure sensor PS-04 is replaced", [("3.2", None)]),
        ("Do not install PS-04A on a controller running firmware older than 3.2.", [(None, "3.2")]), ("Requires controller firmware >= 3.2", [("3.2", None)]), ("Applies to software revisions 3.0 and 3.1 only.", [("3.0", "3.1")]),
        ("PS-04 on revisions prior to 3.2, PS-04A on revision 3.2 and later", [(None, "3.2"), ("3.2", None)]), ("The pump runs at 200 bar", []), ("revised from 180 bar to 200 bar", []), (None, []),
    ],
)
def test_cues(text, want):
    assert [(c["lo"], c["hi"]) for c in cues_of(text)] == want


def test_quantities(spark):
    one = spark.sql("SELECT 'reaches 200 bar. 10 seconds, 210°C or 0.18 MPa; not 5 barrels, -4 °C' AS s").select(F.expr(quantity.parse("s")).alias("q"), F.expr(quantity.in_own_unit("0.18D", "'MPa'")).alias("mpa"), F.expr(quantity.in_own_unit("18D", "'MPa'")).alias("m18")).first()
    assert [tuple(q) for q in one["q"]] == [(200.0, "bar"), (10.0, "second"), (210.0, "degC"), (1.8, "bar"), (-4.0, "degC")]
    assert (one["mpa"], one["m18"]) == (1.8, 180.0)


def test_names(spark):
    f = mentions.Finder({"PS-04": "a", "PS-04A": "b", "discharge pressure sensor": "a"})
    got = f.find("P.S.04-A? The Discharge pressure sensor PS-04A, not PS-04, PS-40 or XPS-04.")
    assert [(m["surface"], m["entity_id"]) for m in got] == [("Discharge pressure sensor", "a"), ("PS-04A", "b"), ("PS-04", "a"), ("PS-40", None), ("XPS-04", None)]
    a = mentions.keyed(spark.createDataFrame([("a", "PS-04", "register"), ("b", "P.S. 04", "glossary"), ("c", "the unit", "asserted"), ("d", "N/A", "register")], "entity_id string, surface string, status string"))
    with pytest.raises(ValueError, match="PS04"):
        mentions.check(a)
    assert {r["status"] for r in a.filter("entity_id = 'c'").collect()} == {"rejected"} and a.filter("entity_id = 'd'").count() == 0


def test_html_and_json():
    assert markup.blocks_of("<p>One&nbsp;&amp; two <b>three</b> .</p><script>x</script><ul><li>a</li><li>b") == ["One & two three.", "a", "b"]
    assert markup.blocks_of(None) == []
    assert [(x["json_path"], x["text"]) for x in markup.leaves_of({"a": {"b": [1, {"c": 2}], "d": None}})] == [("a.b", 'a.b = [1, {"c": 2}]'), ("a.d", "a.d = null")]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w, a = 'xmlns:w="w"', 'xmlns:a="a" xmlns:p="p"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    docx = zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello  there</w:t></w:r></w:p><w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('x')}{cell('y')}</w:tr></w:tbl></w:body></w:document>"})
    pptx = zipped({"ppt/slides/slide1.xml": f"<p:sld {a}><p:sp><a:p><a:t>Title</a:t></a:p></p:sp></p:sld>"})
    xlsx = zipped({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>Alarm</t></si><si><t>A17</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></worksheet>'})
    for name, data in {"manuals/a.docx": docx, "extra/b.pptx": pptx, "reference/c.xlsx": xlsx, ".hidden/d.docx": docx}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files(spark, str(tmp_path))
    assert [(r["doc_id"], r["family"]) for r in found.orderBy("doc_ord").collect()] == [("extra/b.pptx", "slides"), ("manuals/a.docx", "manual"), ("reference/c.xlsx", "reference")]
    got = {(r["doc_id"], r["kind"]): r for r in markup.office_elements(found).collect()}
    assert got["manuals/a.docx", "paragraph"]["text"] == "Hello there" and got["manuals/a.docx", "row"]["cell_list"] == ["x", "y"]
    assert got["extra/b.pptx", "slide_text"]["slide"] == 1 and got["reference/c.xlsx", "row"]["cells"] == {"Alarm": "A17"}
