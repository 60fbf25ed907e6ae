import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from lodeweave.functions.matching import Arithmetic, QuadMatcher, filter_quads, map_quads
from lodeweave.operators.index import build_index, to_dataset
from lodeweave.operators.pipeline import run_pipeline
from lodeweave.sources import rdf, results

NT = """<http://x/a> <http://x/p> <http://x/b> .
_:n1 <http://x/q> "say \\"hi\\"\\n"@en .
<http://x/a> <http://x/r> "12.5"^^<http://www.w3.org/2001/XMLSchema#double> .
<http://x/a> <http://x/t> "true"^^<http://www.w3.org/2001/XMLSchema#boolean> .
<http://x/a> <http://x/i> "[ 1.0 ; 2.0 )" .
# comment
not a triple
"""
WANT = {
    ("http://x/a", "http://x/p", "uri", "http://x/b"), ("_:n1", "http://x/q", "text", 'say "hi"\n'), ("http://x/a", "http://x/r", "number", "12.5"),
    ("http://x/a", "http://x/t", "boolean", "true"), ("http://x/a", "http://x/i", "interval", "[ 1.0 ; 2.0 )"),
}


def triples(df):
    return {(r["s"], r["p"], r["o"]["kind"], r["o"]["value"]) for r in df.collect()}


def quads(df):
    return {(r["s"], r["p"], r["o"]["value"], r["g"]) for r in df.collect()}


@pytest.mark.parametrize("name,pack", [("a.nt", None), ("a.nt.gz", gzip.compress), ("a.nt.bz2", bz2.compress)])
def test_lines_plain_and_packed(spark, tmp_path, name, pack):
    path = tmp_path / name
    path.write_bytes(pack(NT.encode()) if pack else NT.encode())
    df = rdf.read_quads(spark, str(path))
    assert triples(df) == WANT
    out = str(tmp_path / "out")
    rdf.write_quads(df, out, "nt")
    assert triples(rdf.read_quads(spark, out, "nt")) == WANT


HARD = r"""<http://x/a><http://x/p><http://x/b>.
<http://x/a> <http://x/p> "C:\\temp\tnew" .
_:b.1 <http://x/p> _:c.d .
<http://x/a> <http://x/p> "caf\u00e9 \U0001F600 \uD83D\uDE00 \uD800 \"x\"" <http://x/g> .
<http://x/\u00e9> <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer>.# comment

<http://x/a> <http://x/p> unquoted .
"""


def test_escapes_and_grammar_of_lines(spark, tmp_path):
    path = tmp_path / "h.nq"
    path.write_text(HARD + '<http://x/long> <http://x/p> "' + 'a\\\\b' * 40_000 + '" .\n', encoding="utf-8")
    df = rdf.read_quads(spark, str(path))
    got = {(s, o if len(o) < 100 else len(o), g) for s, _, o, g in quads(df)}
    assert got == {
        ("http://x/a", "http://x/b", ""), ("http://x/a", "C:\\temp\tnew", ""), ("_:b.1", "_:c.d", ""), ("http://x/a", 'caf\u00e9 \U0001f600 \U0001f600 \ufffd "x"', "http://x/g"),
        ("http://x/\u00e9", "5", ""), ("http://x/long", 120_000, ""),
    }
    assert [r["value"] for r in rdf.rejected_lines(spark, str(path)).collect()] == ["<http://x/a> <http://x/p> unquoted ."]
    want = quads(df)
    for kind in ("nq", "trig", "trix"):
        rdf.write_quads(df.coalesce(1), str(tmp_path / kind), kind)
        files = [p for p in (tmp_path / kind).iterdir() if p.name.startswith("part")]
        files[0].rename(tmp_path / f"back.{kind}")
        assert quads(rdf.read_quads(spark, str(tmp_path / f"back.{kind}"))) == want


def test_graphs_survive_nq(spark, tmp_path):
    path = tmp_path / "a.nq"
    path.write_text('<http://x/a> <http://x/p> "v" <http://x/g> .\n<http://x/a> <http://x/p> _:b .\n')
    df = rdf.read_quads(spark, str(path))
    want = {("http://x/a", "http://x/p", "v", "http://x/g"), ("http://x/a", "http://x/p", "_:b", "")}
    assert quads(df) == want
    rdf.write_quads(df, str(tmp_path / "o"), "nq", "gzip")
    assert quads(rdf.read_quads(spark, str(tmp_path / "o"), "nq")) == want


TTL = """@prefix x: <http://x/> . @base <http://base/> .
x:a x:p x:b , <rel> ; a x:C ; x:n 4.5 ; x:t true ; x:s '''long
text''' , "typed"^^x:d , "tag"@en-GB .
x:b x:list ( 1 x:c ) ; x:in [ x:q "in" ] .
[ x:q x:d ] .
"""


@pytest.mark.parametrize("name", ["a.ttl", "a.ttl.gz"])
def test_turtle(spark, tmp_path, name):
    path = tmp_path / name
    path.write_bytes(gzip.compress(TTL.encode()) if name.endswith("gz") else TTL.encode())
    got = triples(rdf.read_quads(spark, str(path)))
    a = "http://x/a"
    assert {(a, "http://x/p", "uri", "http://x/b"), (a, "http://x/p", "uri", "http://base/rel"), (a, rdf.RDF + "type", "uri", "http://x/C"), (a, "http://x/n", "number", "4.5"), (a, "http://x/t", "boolean", "true"), (a, "http://x/s", "text", "long\ntext"), (a, "http://x/s", "text", "typed"), (a, "http://x/s", "text", "tag")} <= got
    assert len(got) == 8 + 1 + 4 + 2 + 1


def test_trig_rdfxml_trix_jsonld(spark, tmp_path):
    files = {
        "a.trig": "@prefix x: <http://x/> . x:g { x:a x:p x:b . } GRAPH x:h { x:a x:p 'v' } { x:a x:p x:c }",
        "a.rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/"><rdf:Description rdf:about="http://x/a"><x:p rdf:resource="http://x/b"/><x:p>v</x:p></rdf:Description><x:C rdf:about="http://x/d"/></rdf:RDF>',
        "a.trix": '<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/"><graph><uri>http://x/g</uri><triple><uri>http://x/a</uri><uri>http://x/p</uri><plainLiteral>v</plainLiteral></triple></graph></TriX>',
        "a.jsonld": '{"@context": {"x": "http://x/", "p": {"@id": "x:p", "@type": "@id"}}, "@id": "x:a", "p": "x:b", "x:n": 3, "x:in": {"@id": "x:c", "x:q": "v"}}',
    }
    got = {}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        got[name] = quads(rdf.read_quads(spark, str(tmp_path / name)))
    a, p = "http://x/a", "http://x/p"
    assert got["a.trig"] == {(a, p, "http://x/b", "http://x/g"), (a, p, "v", "http://x/h"), (a, p, "http://x/c", "")}
    assert got["a.rdf"] == {(a, p, "http://x/b", ""), (a, p, "v", ""), ("http://x/d", rdf.RDF + "type", "http://x/C", "")}
    assert got["a.trix"] == {(a, p, "v", "http://x/g")}
    assert got["a.jsonld"] == {(a, p, "http://x/b", ""), (a, "http://x/n", "3", ""), ("http://x/c", "http://x/q", "v", ""), (a, "http://x/in", "http://x/c", "")}


def test_tsv_modes(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text('A\tp\tB .\n<http://x/a>\tq\t"4"^^xsd:int\nA\tr\t5.5\nA\tt\t"text"\ntwo\tfields\n')
    kinds = {mode: {(r["p"], r["o"]["kind"], r["o"]["value"]) for r in rdf.read_quads(spark, str(path), tsv_mode=mode).collect()} for mode in ("raw", "parsed_uris", "parsed_literals")}
    assert kinds["raw"] == {("p", "uri", "B"), ("q", "uri", '"4"^^xsd:int'), ("r", "uri", "5.5"), ("t", "uri", '"text"')}
    assert kinds["parsed_literals"] == {("p", "uri", "B"), ("q", "number", "4"), ("r", "number", "5.5"), ("t", "text", "text")}


def test_sql_dump(spark, tmp_path):
    path = tmp_path / "a.sql"
    path.write_text("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(9), n DOUBLE, ok BOOLEAN, r INT REFERENCES u(k));\nINSERT INTO t VALUES (1,'a; b''c',2.5,1,7),(NULL,'x',1,0,1),(2,NULL,3,0,8);")
    assert triples(rdf.read_quads(spark, str(path))) == {
        ("t/id/1", "name", "text", "a; b'c"), ("t/id/1", "n", "number", "2.5"), ("t/id/1", "ok", "boolean", "true"), ("t/id/1", "r", "uri", "u/k/7"),
        ("t/id/2", "n", "number", "3"), ("t/id/2", "ok", "boolean", "false"), ("t/id/2", "r", "uri", "u/k/8"),
    }


SAME = "\n".join(f"{s} {p} {o} ." for s, p, o in [("<b>", "<http://www.w3.org/2002/07/owl#sameAs>", "<a>"), ("<c>", "<http://www.w3.org/2002/07/owl#sameAs>", "<d>"), ("<x>", "<http://www.w3.org/2002/07/owl#sameAs>", "<p>"),
    ("<a>", "<p>", '"1"'), ("<b>", "<x>", '"2"'), ("<d>", "<p>", "<a>")])


def test_index_resolves_same_as(spark, tmp_path):
    path = tmp_path / "s.nt"
    path.write_text(SAME + "\n")
    index = build_index(rdf.read_quads(spark, str(path)))
    assert triples(to_dataset(index)) == {("b", "x", "text", "1"), ("b", "x", "text", "2"), ("c", "x", "uri", "b")}


def test_matchers_and_mappers(spark):
    df = spark.createDataFrame([("http://x/a", "http://x/p", "3"), ("http://x/b", "http://x/q", "5")], "s string, p string, v string")
    df = df.select("s", "p", F.struct(F.lit("number").alias("kind"), F.col("v").alias("value"), F.col("v").cast("double").alias("num"), *[F.lit(None).cast(t).alias(c) for c, t in (("lo", "double"), ("hi", "double"), ("lo_open", "boolean"), ("hi_open", "boolean"))]).alias("o"), F.lit("").alias("g"))
    assert filter_quads(df, [QuadMatcher(object="(3 ; 5]")]).count() == 1
    assert filter_quads(df, [QuadMatcher(subject="<.*a>", inverse=True)]).first()["s"] == "http://x/b"
    out = {r["s"]: r["o"]["num"] for r in map_quads(df, QuadMatcher(subject="http://x/(.)"), subject="http://y/$s1", object="$o0 * 2 + 1").collect()}
    assert out == {"http://y/a": 7.0, "http://y/b": 11.0}
    with pytest.raises(ValueError):
        Arithmetic("1 + (2", {})


def test_pipeline_end_to_end(spark, tmp_path):
    people = [f"<http://x/s{i}> <http://x/knows> <http://x/s{(i * 3 + 1) % 12}> ." for i in range(12)] + [f"<http://x/s{i}> <http://x/likes> <http://x/s{(i * 3 + 1) % 12}> ." for i in range(9)]
    path = tmp_path / "k.nt"
    path.write_text("\n".join(people))
    start = [{"name": "LoadGraph", "parameters": {"path": str(path)}}]
    assert run_pipeline(spark, [*start, {"name": "DatasetSize"}]) == 21
    assert [r["n"] for r in run_pipeline(spark, [*start, {"name": "Histogram", "parameters": {"predicate": True}}])] == [12, 9]
    mine = [*start, {"name": "Index"}, {"name": "Mine", "parameters": {"thresholds": [{"name": "MinHeadSize", "value": 1}, {"name": "MinSupport", "value": 5}], "constraints": [{"name": "WithoutConstants"}]}}]
    rules = str(tmp_path / "rules")
    n = run_pipeline(spark, [*mine, {"name": "ComputeConfidence", "parameters": {"name": "CwaConfidence", "min": 0.5}}, {"name": "ExportRules", "parameters": {"path": rules}}, {"name": "RulesetSize"}])
    back = results.read_rules(spark, rules)
    assert n == back.count() > 0 and back.where("support >= 5 and cwa_confidence >= 0.5").count() == n
    out = run_pipeline(spark, [*mine, {"name": "ComputeConfidence", "parameters": {"name": "PcaConfidence"}}, {"name": "Predict"}, {"name": "GroupPredictions"}, {"name": "ToPredictionTasks", "parameters": {"generator": "Subject"}}, {"name": "Evaluate"}])
    assert out["total"] > 0 and 0 < out["mrr"] <= 1
    with pytest.raises(ValueError):
        run_pipeline(spark, [*start, {"name": "Mine"}])


def test_streamed_predictions(spark, tmp_path):
    from lodeweave.operators.mining import MiningTask, mine
    from lodeweave.streaming.predictions import stream_predictions

    known = spark.createDataFrame([(i, p, i + 1) for i in range(6) for p in (1, 2)], "s long, p long, o long")
    rules = mine(known, MiningTask(min_head_size=1, min_support=3, max_length=2)).persist()
    spark.createDataFrame([(50, 1, 60)], "s long, p long, o long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, p long, o long").parquet(str(tmp_path / "in"))
    stream_predictions(stream, rules, known, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["s"], r["p"], r["o"]) for r in spark.read.parquet(str(tmp_path / "out/predictions/batch=0")).collect()}
    assert got == {(50, 2, 60)}


def test_entry_lists_queries():
    import __spark_entry__ as e

    names, sql = set(e.queries()), set(e.oracle_sql())
    assert sql <= names and {"rules_len3", "histogram_p", "ranking_metrics", "p4_found"} <= names
