"""Sources, sinks, command line, streams, and queries against SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphsift import cli
from glyphsift.operators import carriers, prompts, rewrite, similarity
from glyphsift.plans import catalog
from glyphsift.sources import files
from glyphsift.streaming import detect

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["pages_comment_carrier", "carrier_report", "normalize_carriers", "token_edits", "detect_language", "keyed_green_list", "keyed_context_selfhash", "corpus_test", "steal_and_test", "overlap_cost", "model_registry"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\xffb")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first().text == "a�b"
    (tmp_path / "p.json").write_text(json.dumps({"en": {"preserved": [["a", "b"]], "changed": [["c", "d"], ["e", "f"]]}}))
    assert files.labelled_pairs(spark, str(tmp_path / "p.json")).count() == 3
    report = carriers.detect_carriers(spark.createDataFrame([(0, "x​ sk-abcdefghijklmnop12")], "doc_id long, text string"))
    body = json.loads(files.report_json(report).first().json)
    assert body["schema_version"] == "1.0" and body["findings"][0]["kind"] == "zero_width"
    assert "zero_width" in files.to_markdown(report)
    files.write_reports(report, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_cli(spark, tmp_path, capsys):
    bad, good = tmp_path / "bad.txt", tmp_path / "good.txt"
    bad.write_text("hid​den", encoding="utf-8")
    good.write_text("It is fine.", encoding="utf-8")
    assert cli.main(["detect", str(bad), "--json"], spark) == 2 and "zero_width" in capsys.readouterr().out
    assert cli.main(["detect", str(good)], spark) == 0
    assert cli.main(["report", str(bad)], spark) == 0
    capsys.readouterr()
    assert cli.main(["bleach", str(bad)], spark) == 0 and capsys.readouterr().out == "hidden\n"
    assert cli.main(["bleach", str(good), "--strength", "2"], spark) in (0, 1)
    assert cli.main(["hardware"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["bleach", "--strength", "3"], spark)
    capsys.readouterr()
    cli.main(["bleach", str(bad), "--strength", "3", "--model", "pyspark.sql.functions:upper", "--json"], spark)
    said = capsys.readouterr()
    assert json.loads(said.out)["strength"] == 3 and said.err.strip() in ("HIDDEN", "hidden")


def test_prompts(spark):
    df = spark.createDataFrame([("x ANSWER: Red", "red", "blue"), ("I say blue", "red", "blue"), ("", "red", "blue"), ("ANSWER: green", "red", "blue"), (None, "red", "blue")], "answer string, a string, b string")
    assert [r.c for r in df.select(prompts.parse_choice(F.col("answer"), F.col("a"), F.col("b")).alias("c")).collect()] == ["a", "b", None, None, None]
    asked = df.select(prompts.choice_prompt(F.lit("A walk."), F.col("a"), F.col("b"), F.monotonically_increasing_id()).alias("p")).select("p.*").collect()
    assert all(("red or blue" in r.prompt) == r.first_is_a and "A walk." in r.prompt for r in asked)
    assert "C module" in prompts.generation_prompt("add", "int add(int, int)", "c") and "f(x)" in prompts.rewrite_prompt("def f(x): ...", "f(x)", mode="canonical")
    with pytest.raises(ValueError):
        prompts.rewrite_prompt("", "f", mode="x")
    assert spark.createDataFrame([("```python\nx = 1\n```",)], "a string").select(prompts.clean_answer(F.col("a"))).first()[0] == "x = 1"


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "lex.json").write_text(json.dumps({"groups": [{"pivot": "uno", "words": ["one", "single"]}, {"pivot": "dos", "words": ["single", "two"]}]}))
    lex = rewrite.load_lexicon(str(tmp_path / "lex.json"))
    assert rewrite.english_vocabulary(lex) == ["one", "single", "two"] and files.lexicon(spark, str(tmp_path / "lex.json")).count() == 2
    got = spark.createDataFrame([("One Single TWO x",)], "t string").select(rewrite.roundtrip_translate(F.col("t"), lex)).first()[0]
    assert got == "Single Two TWO x"  # a word in two groups goes by the later one
    assert len(rewrite.LEXICON) >= 60 and all(p.isalpha() and p.isascii() for p in rewrite.LEXICON)
    (tmp_path / "spec.json").write_text(json.dumps({"en": {"metric": "char", "threshold": 0.9, "char_n": 3}, "und": {"metric": "char", "threshold": 0.1, "char_n": 3}}))
    table = files.language_specs(spark, str(tmp_path / "spec.json"))
    rows = similarity.with_spec(spark.createDataFrame([("en-US",), ("xx",), (None,)], "lang string"), table=table).collect()
    assert sorted(r.threshold for r in rows) == [0.1, 0.1, 0.9]


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", "x​" if i % 2 else "plain", f"s{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, ts string, text string, source string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))

    def run(make, mode):
        q = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    assert sum(r.alarm for r in run(detect.scan_stream, "append")) == 6
    assert {r.source: r.scored for r in run(lambda s: detect.running_counts(s), "complete")} == {"s0": 6, "s1": 6}
    got = run(lambda s: detect.alert_windows(detect.scan_stream(s)), "complete")
    want = detect.alert_windows(detect.scan_stream(df)).collect()
    assert sorted((r.window.start, r.n, r.alarms) for r in got) == sorted((r.window.start, r.n, r.alarms) for r in want)
    assert len(run(detect.first_copies, "append")) == 2
    assert run(lambda s: detect.alert_sessions(s, "source"), "complete")
