"""What goes wrong and how it is told: configuration, findings, clashing columns, repeated keys, delivery."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.config import Engine, InvalidConfig, InvalidFinding, InvalidRequest, Recognizer, RegexError, Rule
from maskwright.operators import rules as R
from maskwright.operators.mask import CANDIDATES, findings, mask, resolved
from maskwright.operators.restore import restore
from maskwright.operators.session import anonymize
from maskwright.streaming.delivery import deliver
from maskwright.streaming.stream import restore_stream


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def test_configuration_is_refused(spark):
    with pytest.raises(InvalidConfig):
        Engine().with_keywords("a", "b", "a")
    for words in ([], [""], ["x" * 65_537], [f"w{i}" for i in range(3001)]):
        with pytest.raises(InvalidConfig):
            Engine().with_keywords(*words)
    for score in (-0.1, 1.1, float("nan"), float("inf")):
        with pytest.raises(InvalidFinding):
            Engine().with_recognizers(Rule("x", "EMAIL", "x", score)).plan()
    with pytest.raises(RegexError):
        mask(texts(spark, "a"), Engine().with_recognizers(Rule("x", "EMAIL", "(", 0.5)))
    for name in ("", "keyword", "n" * 129):
        with pytest.raises(InvalidConfig):
            Engine().with_recognizers(Rule(name, "EMAIL", "x", 0.5)).plan()
    with pytest.raises(InvalidConfig):
        Engine().with_limits(max_entities=0)


def found(entity="EMAIL", start=0, end=1, score=0.5, text="a"):
    one = F.struct(F.lit(entity).alias("entity"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(score).alias("score"), F.lit(text).alias("text"))
    return Engine().with_recognizers(Recognizer("own", lambda t: F.array(one)))


@pytest.mark.parametrize("wrong,why", [({"entity": "OTHER"}, "UnknownEntityType"), ({"end": 5}, "InvalidFinding"), ({"end": 0}, "InvalidFinding"), ({"text": "b"}, "InvalidFinding"), ({"score": 1.5}, "InvalidFinding"), ({"start": -1}, "InvalidFinding"), ({"score": float("nan")}, "InvalidFinding")])
def test_findings_of_functions_are_held_against_the_text(spark, wrong, why):
    assert mask(texts(spark, "abc"), found()).first()["masked"] == "[EMAIL_1]bc"
    with pytest.raises(Exception, match=why):
        mask(texts(spark, "abc"), found(**wrong)).collect()


def test_many_keyword_matches_end_in_an_error(spark):
    rows = texts(spark, "a" * (1 << 20), "aaa", "a" * 6000)
    got = [(r["masked"], r["error"]) for r in mask(rows, Engine().with_recognizers().with_keywords("a", "aa")).orderBy("id").collect()]
    assert got[0] == (None, "LimitExceeded") and got[1] == ("[KEYWORD_1][KEYWORD_2]", None) and got[2][1] is None and got[2][0].endswith("[KEYWORD_3000]")


def test_a_span_inside_a_character_is_invalid(spark):
    with pytest.raises(Exception, match="InvalidFinding"):
        mask(texts(spark, "中"), found(start=1, end=3, text="x")).collect()


def test_empty_matches_are_invalid(spark):
    with pytest.raises(Exception, match="InvalidFinding"):
        mask(texts(spark, "abc"), Engine().with_recognizers(Rule("x", "EMAIL", "x*", 0.5))).collect()


def test_strategies_must_give_text(spark):
    engine = Engine().with_strategy("EMAIL", lambda e, t, n: F.unhex(F.lit("C3")).cast("string"))
    with pytest.raises(Exception, match="InvalidUTF8"):
        mask(texts(spark, "a@b.co"), engine).collect()


def test_columns_that_clash_are_replaced_or_kept(spark):
    rows = spark.createDataFrame([("s", 1, "a@b.co", "old", "x", 7, "y")], "s string, n int, text string, error string, __r0 string, masked int, __s string")
    for out in (mask(rows), anonymize(rows, "s", "n")):
        assert sorted(out.columns) == sorted({*rows.columns, "events"})
        r = out.first()
        assert (r["masked"], r["error"], r["__r0"], r["__s"]) == ("[EMAIL_1]", None, "x", "y")
    named = rows.withColumn("restored", F.lit(1)).withColumn("__map", F.lit(2))
    known = spark.createDataFrame([("s", "[EMAIL_1]", "a@b.co")], "s string, placeholder string, plaintext string")
    r = restore(named.withColumn("text", F.lit("to [EMAIL_1]")), known, "s").first()
    assert (r["restored"], r["__map"], r["error"]) == ("to a@b.co", 2, None)
    assert findings(rows.withColumn("entity", F.lit("own")), keep=("s", "n")).select("s", "n", "entity", "match").first() == ("s", 1, "EMAIL", "a@b.co")


def test_null_sessions_and_repeated_calls(spark):
    rows = spark.createDataFrame([(None, 1, "a@b.co"), (None, 2, "c@d.co a@b.co"), ("x", None, "a@b.co"), ("x", 1, None)], "s string, n int, text string")
    got = {(r["s"], r["n"]): (r["masked"], r["error"]) for r in anonymize(rows, "s", "n").collect()}
    assert got == {(None, 1): ("[EMAIL_1]", None), (None, 2): ("[EMAIL_2] [EMAIL_1]", None), ("x", None): ("[EMAIL_1]", None), ("x", 1): (None, None)}
    with pytest.raises(InvalidRequest):
        anonymize(rows.union(rows), "s", "n")


def test_order_of_candidates_does_not_matter(spark):
    spans = [("URL", 0, 10, 0.7, 0), ("EMAIL", 0, 10, 0.7, 1), ("IP", 0, 10, 0.7, 2), ("PHONE", 8, 14, 0.9, 3), ("SECRET", 12, 13, 0.1, 4), ("EMAIL", 14, 20, 0.2, 5)]
    rng, rows = random.Random(1), []
    for _ in range(256):
        own = list(spans)
        rng.shuffle(own)
        rows.append(([(e, a, b, s, "", a, b, i, i) for e, a, b, s, i in own],))
    frame = spark.createDataFrame(rows, f"c {CANDIDATES}")
    got = {tuple((x["entity"], x["start"]) for x in r["r"]) for r in frame.select(resolved(F.col("c")).alias("r")).collect()}
    assert got == {(("URL", 0), ("SECRET", 12), ("EMAIL", 14))}


def test_random_texts_against_plain_python(spark):
    """Boundary rules, e-mail and resolution over random strings, as plain Python would do it."""
    rng = random.Random(11)
    parts = ["a@b.co", "13800138000", "+8613800138000", "10.0.0.1", "x", "é", "7", " ", ".", "-", "@", "4111111111111111", "123-45-6789"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    rules = [R.EMAIL, R.INTL_PHONE, R.CHINA_PHONE]

    def plain(text):
        spans = []
        for k, (p, edge, score) in enumerate([(R.EMAIL_PATTERN, False, 0.9), (R.INTL_PHONE.pattern, True, 0.8), (R.CHINA_PHONE.pattern, True, 0.7)]):
            for m in re.finditer(p, text, re.ASCII):
                near = text[max(m.start() - 1, 0) : m.start()] + text[m.end() : m.end() + 1]
                if not (edge and re.search("[0-9]", near)):
                    size = len(m[0].encode())
                    spans.append((-size, -score, k, m.start(), m.end(), "EMAIL" if k == 0 else "PHONE"))
        kept = []
        for s in sorted(spans):
            if all(s[4] <= o[3] or o[4] <= s[3] for o in kept):
                kept.append(s)
        out, at, seen = "", 0, {}
        for s in sorted(kept, key=lambda x: x[3]):
            seen[s[5]] = seen.get(s[5], 0) + 1
            out += text[at : s[3]] + f"[{s[5]}_{seen[s[5]]}]"
            at = s[4]
        return out + text[at:]

    got = {r["id"]: r["masked"] for r in mask(texts(spark, *values), Engine().with_recognizers(*rules)).collect()}
    assert [got[i] for i in range(len(values))] == [plain(t) for t in values]


def test_delivery_counts_rows_once_and_reports_before(spark, tmp_path):
    schema = "stream_id string, chunk_no long, chunk binary, is_eof boolean, mapping map<string,string>"
    rows = spark.createDataFrame([("q", 0, b"x [PHO", False, {"[PHONE_1]": "13800138000"}), ("q", 1, b"NE_1] y", True, None)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = []

    def run(report):
        query = deliver(restore_stream(chunks), str(tmp_path / "out"), str(tmp_path / "check"), report)
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()

    def refuse(batch):
        raise ValueError("no report, no delivery")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    with pytest.raises(Exception, match="no report"):
        run(refuse)
    assert not (tmp_path / "out").exists()
    run(lambda batch: seen.append(batch.count()))
    run(lambda batch: seen.append(batch.count()))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_no").collect()
    assert "".join(r["text"] for r in out) == "x 13800138000 y" and sum(seen) == len(out)
