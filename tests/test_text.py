"""Text rules and readers on inline rows, including the edges."""

import json

from pyspark.sql import functions as F

from stylegraph.functions import text as X
from stylegraph.sources import documents as S
from stylegraph.sources.staging import is_written, stage
from stylegraph.streaming.pending import answer_stream


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_word_difference_pads(spark):
    df = spark.createDataFrame([("a b c", "a x"), ("", "a b"), (" a  b ", "a b"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(X.word_difference(F.col("a"), F.col("b"))).collect()] == [2, 2, 0, 0]


def test_levels_defaults_and_last_heading(spark):
    text = ("Here you go\n\n**Semantic Level:**\n\n* **first**\n- second\n\nNonsense\n\n- x\n\n"
            "Semantic Level\n\n- third\n\nDiscourse Level")
    got = one(spark, text, X.extract_levels)
    assert got == {"Morphological Level": ["other"], "Syntactic Level": ["other"],
                   "Semantic Level": ["third"], "Discourse Level": ["other"]}
    assert one(spark, "", X.extract_levels)["Syntactic Level"] == ["other"]


def test_markdown_attributes(spark):
    assert one(spark, "x **Bold (much)** y\n* line (a)\nz", X.extract_markdown_attributes) == ["Bold", "line"]
    assert one(spark, "none", X.extract_markdown_attributes) == ["other"]


def test_chunks(spark):
    assert one(spark, "abcdefghij", lambda c: X.chunk_text(c, 4)) == ["ab", "cd", "ef", "gh", "ij"]
    assert one(spark, "ab<PERSON>cde", lambda c: X.chunk_text(c, 4)) == ["a", "b", "c", "d", "e"]
    assert one(spark, "abc", lambda c: X.chunk_text(c, 4)) == []


def test_model_names_and_paths(spark):
    assert one(spark, "ABC:123", X.valid_model_name) is True
    assert one(spark, "ABC123", X.valid_model_name) is False
    assert one(spark, "/a-b/in-put-x.csv", lambda c: X.rename_first_word(c, "new")) == "/a-b/new-put-x.csv"
    assert one(spark, "plain.csv", lambda c: X.rename_first_word(c, "new")) == "new"


def test_longest_first(spark):
    rows = spark.createDataFrame([(["big word", "word", "long big word", "other", "big word x"],)], "p array<string>")
    got = rows.select(X.longest_first_dedupe(F.col("p"))).first()[0]
    assert got == ["long big word", "big word x", "other"]


def test_phrases(spark):
    lexicon = spark.createDataFrame([("long", "ADJ"), ("word", "NOUN"), ("list", "NOUN"), ("often", "ADV"),
                                     ("plain", "ADJ"), ("very", "ADV")], "token string, tag string")
    rows = spark.createDataFrame([("Long word list often here",), ("The word is very plain",), ("none",)],
                                 "feature string")
    got = {r["feature"]: r["phrases"] for r in X.mine_phrases(rows, lexicon).collect()}
    assert got == {"Long word list often here": ["long word list often"],
                   "The word is very plain": ["word is very plain"], "none": []}


def test_finished_rules(spark):
    lexicon = spark.createDataFrame([("words",), ("plain",), ("with",), ("tone",), ("style",)], "word string")
    tags = spark.createDataFrame([("quickly", "ADV"), ("their", "PRP$")], "token string, tag string")
    cases = {"": False, "  ": False, "Done.": True, "It goes on...": True, "uses words": True,
             "written such as": False, "uses words with": False, "uses (words": False, "the \"tone": False,
             "unknown blah": False, "done quickly": False, "rich and style": False,
             "based on style": False, "rich in their": False, "so plain": True}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["finished"] for r in X.is_sentence_finished(df, "s", lexicon, tags).collect()}
    assert got == cases


def test_verdicts(spark):
    cases = {"Paragraph 1 better.": (True, True), "I say paragraph 2 is": (False, True),
             "The second paragraph": (False, True), "[paragraph 1] better": (True, True), "no": (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: tuple(r["v"]) for r in df.select("s", X.classify_verdict(F.col("s")).alias("v")).collect()}
    assert got == cases


def test_lists_and_labels(spark):
    assert one(spark, "['a', 'b']", S.parse_list) == ["a", "b"]
    assert one(spark, "[a, 'b']", S.parse_list) == ["a", "b"]
    assert one(spark, "('x1',)", S.decode_label) == "x1"
    assert one(spark, "x1", S.decode_label) == "x1"


def test_column_json(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": {"0": "x", "1": "y"}, "b": {"0": 1, "1": 2}}, indent=1))
    got = {(r["idx"], r["a"], r["b"]) for r in S.read_column_json(spark, str(tmp_path), ["a", "b"]).collect()}
    assert got == {(0, "x", "1"), (1, "y", "2")}


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi",\nthen go')], "id int, t string")
    S.write_style_csv(rows, str(tmp_path / "c"))
    assert S.read_style_csv(spark, str(tmp_path / "c"), rows.schema).first()["t"] == 'say "hi",\nthen go'


def test_stage_redoes_half_written(spark, tmp_path):
    path = tmp_path / "s"
    path.mkdir()
    (path / "part-0.parquet").write_text("broken")
    assert not is_written(spark, str(path))
    assert stage(spark, str(path), lambda: spark.range(3)).count() == 3
    assert stage(spark, str(path), lambda: spark.range(9)).count() == 3


def test_stream_answers_each_request_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "instruction string, input string"
    for inputs in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([("say", x) for x in inputs], schema).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        answer_stream(stream, out, str(tmp_path / "cp"), lambda i, x: x * 2).awaitTermination(120)
    got = sorted((r["input"], r["generations"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", "aa"), ("b", "bb"), ("c", "cc")]


def test_levels_do_not_grow_with_their_uses(spark):
    # each step of the answer is bound once; it was written out again for every level and list
    from pyspark.sql import functions as F
    from stylegraph.registry.base import text_vector
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(
        X.extract_levels(F.col("t")).alias("l"), text_vector(F.col("t")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(t") == 1
    vector = spark.range(1).select(text_vector(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert vector.index("md5") < vector.rindex("lambdafunction") and "substr(concat(md5" not in vector.lower()
