import gzip
import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from termscan.operators import compile as lexicons
from termscan.functions import table_functions
from termscan.functions.predicates import relaxed_match
from termscan.operators import features, multiscan, report
from termscan.sources import bundles, lexicons as files, messages, pattern_files
from termscan.streaming.scan import scan_stream, write_hits


def test_pattern_file_round_trip(spark, tmp_path):
    rows = [(0, "price|spread", [1]), (None, "a\x00💰é", [1, 2, 64]), (7, "", [])]
    body = pattern_files.write_head(rows, b"native")
    head = pattern_files.read_head(body + b"xx")
    assert head["expressions"] == rows and head["block_bytes"] == 6 and head["trailing_bytes"] == 2
    (tmp_path / "a.hdb").write_bytes(body)
    (tmp_path / "b.hdb").write_bytes(b"\x7f\xff\xff\xff")
    got = spark.createDataFrame(pattern_files.read_pattern_files(spark, str(tmp_path)).collect(), pattern_files.ROWS)
    assert got.where("error is null").count() == 3 and got.where("error is not null").count() == 1
    with pytest.raises(ValueError, match="truncated"):
        pattern_files.read_head(body[:20])


def test_json_and_names(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"lexiconRuleName": "r", "more": 1, "terms": [{"termId": "1", "termDescription": "a OR b", "riskDriverName": None}, {"termId": "2", "termDescription": "x.*y", "termType": "NLT"}]}))
    got = files.read_json(spark, str(tmp_path / "r.json")).orderBy("position").collect()
    assert [(r.rule, r.position, r.term_id, r.term_type) for r in got] == [("r", 0, "1", "Standard"), ("r", 1, "2", "NLT")]
    names = spark.createDataFrame([("/x/my lex.csv",), (".csv",), (None,), ("plain",)], "p string")
    assert [r[0] for r in names.select(files.rule_name(F.col("p"))).collect()] == ["my lex", ".csv", "unknown_rule", "plain"]
    assert [r[0] for r in names.select(files.safe_name(F.col("p"))).collect()] == ["_x_my_lex.csv", ".csv", "lexicon_rule", "plain"]


def test_bundle(spark, tmp_path):
    good = lexicons.compile_terms(spark, [{"term_id": "1", "term_description": "a OR b"}, {"term_id": "2", "term_description": "[x"}])
    name, body = bundles.bundle(good, "my rule!")
    z = zipfile.ZipFile(BytesIO(body))
    assert name == "my_rule_-compile-bundle.zip" and z.namelist() == ["my_rule_-compile-results.json", "my_rule_.hdb"]
    assert pattern_files.read_head(z.read("my_rule_.hdb"))["expressions"] == [(0, "(?:a|b)", [1])]
    bad = lexicons.compile_terms(spark, [{"term_id": "2", "term_description": "[x"}])
    assert "NO_DATABASE.txt" in zipfile.ZipFile(BytesIO(bundles.bundle(bad, "")[1])).namelist()
    bundles.write_bundle(good, str(tmp_path / "b"))
    assert bundles.read_patterns(spark, str(tmp_path / "b")).count() == 1
    with pytest.raises(ValueError):
        lexicons.checked([{"term_id": " ", "term_description": "x"}])
    rows = spark.createDataFrame([(i, "1", "a AND b", None, None) for i in range(3)], "position int, term_id string, term_description string, risk_driver_name string, term_type string")
    assert lexicons.compile_frame(rows).where("status = 'PASS' and post_filter").count() == 3


def test_messages_and_stream(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("with\nby")
    (tmp_path / "m" / "b.txt").write_text("  ")
    rows = messages.read_files(spark, str(tmp_path / "m"))
    assert [r.message_id for r in rows.collect()] == ["a.txt"]
    rows.write.parquet(str(tmp_path / "p"))
    hits = scan_stream(spark, str(tmp_path / "p"), rows.schema, "body", [("n", "with NEAR{2} by"), ("x", "nothing")])
    write_hits(hits, str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
    assert [r.term_id for r in spark.read.parquet(str(tmp_path / "h")).collect()] == ["n"]
    plan = multiscan.scan(rows, "body", [("n", "with AND by")])
    assert "Python" not in plan._jdf.queryExecution().toString()
    runs = spark.createDataFrame([("1", "2024-01-01"), ("2", "2024-01-02")], "message_id string, run_date string")
    messages.write_run(runs, str(tmp_path / "runs"))
    messages.write_run(runs.where("message_id = '2'"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_dumps_and_table_functions(spark, tmp_path):
    body = pattern_files.write_head([(0, "a|b", [1, 2]), (None, "c", [])])
    (tmp_path / "a.hdb").write_bytes(body)
    (tmp_path / "b.hdb").write_bytes(b"\x00")
    rows = pattern_files.read_pattern_files(spark, str(tmp_path))
    dumped = {r.path.rsplit("/", 1)[1]: json.loads(r.json) for r in pattern_files.dump_json(rows).collect()}
    assert dumped["a.hdb"]["expression_count"] == 2 and "error" in dumped["b.hdb"]
    assert [(e.get("id"), e["flag_names"]) for e in dumped["a.hdb"]["expressions"]] == [(None, ["NO_FLAG"]), (0, ["CASELESS", "DOTALL"])]
    assert sorted(r.line for r in pattern_files.dump_text(rows).collect())[0].startswith("-  NO_FLAG  c")
    table_functions.register(spark)
    found = spark.sql("SELECT * FROM translate_term('copper OR zinc', 'Standard')").first()
    assert (found.status, found.pattern, found.flags) == ("PASS", "(?:copper|zinc)", 1)
    spark.createDataFrame([(bytearray(body),)], "content binary").createOrReplaceTempView("pattern_bytes")
    assert [r.pattern for r in spark.sql("SELECT p.* FROM pattern_bytes, LATERAL pattern_file(content) p").collect()] == ["a|b", "c"]
    bits = spark.createDataFrame([(["CASELESS", "UTF8", "?"],)], "n array<string>").select(lexicons.flag_bits(F.col("n"))).first()[0]
    assert bits == 33


def test_gzip_lexicon_and_csv_report(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt", encoding="utf-8") as f:
        f.write("Term ID,Term Description,Risk Driver Name\n1,copper,R\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "r.csv.gz"), "x").collect()] == [("x", "1", "copper", "R")]
    report.write_csv(spark.createDataFrame([("a", 'say "x", y')], "message_id string, match_text string").coalesce(1), str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert body == '\ufeffmessage_id,match_text\r\na,"say ""x"", y"\r\n'.encode()


def test_outputs(spark, tmp_path):
    hits = spark.createDataFrame([("m1", "2024-01-01", "f", "t1,t2", 2)], "message_id string, run_date string, feature_name string, lexicon_terms string, hit_count_of_terms long")
    stage = spark.createDataFrame([("SUCCESS", 5)], "stage_status string, records_read int")
    records = spark.createDataFrame([("m1", "PROCESSED")], "message_id string, status string")
    for _ in range(2):
        features.write_outputs(str(tmp_path), features.shaped(hits, features.HIT_SUMMARY, pipeline_exec_id="e", total_count_of_terms=F.lit(9)), stage, records)
    back = spark.read.parquet(str(tmp_path / "lexicon-hit-summary"))
    assert back.count() == 1 and back.first().total_count_of_terms == 9 and len(back.columns) == 14
    assert spark.read.parquet(str(tmp_path / "pipeline_stage_audit")).count() == 2 and spark.read.parquet(str(tmp_path / "pipeline_record_audit")).columns == ["pipeline_exec_id", "message_id", "status", "features_applied", "process_ts"]


def test_response_counters_and_notes(spark):
    results = lexicons.compile_terms(spark, [{"term_id": "1", "term_description": "a"}, {"term_id": "2", "term_description": "[x"}, {"term_id": "3", "term_description": "b+", "term_type": "REGEX"}])
    one = lexicons.response(results).first()
    assert (one.total_terms, one.pass_count, one.failed_count, [r.position for r in one.results]) == (3, 2, 1, [0, 1, 2])
    rows, seen = lexicons.observed(results)
    rows.collect()
    assert seen.get == {"passed": 2, "failed": 1, "standard": 2, "raw": 1}
    assert tuple(lexicons.database_note(results).first()) == (True, None, 2)
    assert lexicons.database_note(results.where("status = 'FAILED'")).first().note
    assert messages.as_view(results, "results_now").count() == spark.sql("SELECT * FROM results_now").count()
    totals = report.timed(spark.range(1), 1.0, 2.5).first()
    assert totals.scan_duration_ms == 1500
    relaxed = spark.createDataFrame([("a",), ("b",), (None,)], "t string").select(relaxed_match(F.col("t"), "a AND b")).collect()
    assert [r[0] for r in relaxed] == [True, True, False]


def test_errors_and_their_answers():
    with pytest.raises(lexicons.RequestError) as wrong:
        lexicons.checked([{"term_id": "1", "term_description": " "}, {"term_id": None, "term_description": "x", "term_type": "Other"}])
    answer = lexicons.error_response(wrong.value)
    assert answer["status"] == 400 and list(answer["field_errors"]) == ["terms[0].term_description", "terms[1].term_id", "terms[1].term_type"]
    with pytest.raises(lexicons.TooLarge) as large:
        lexicons.sized(b"x" * (lexicons.MAX_BYTES + 1))
    assert lexicons.error_response(large.value)["status"] == 413 and lexicons.error_response(KeyError("x"))["status"] == 500
    assert lexicons.error_response(lexicons.RequestError({"terms": "must not be empty"}))["message"] == "terms must not be empty"
