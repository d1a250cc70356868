import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm.class_lm import score_documents
from maskwright.llm.decontaminate import contamination, without_spans
from maskwright.llm.fingerprints import fingerprint_neighbours
from maskwright.llm.html_extract import extract, main_text
from maskwright.llm.language_id import Network, identify
from maskwright.llm.licenses import license_scan
from maskwright.llm.line_dedup import dedup_lines
from maskwright.llm.near_dedup import likeness, near_duplicates
from maskwright.llm.packing import pack
from maskwright.llm.pii import listed, personal_data, redacted
from maskwright.llm.tokens import word_ids

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"wort{i} über" for i in range(60))
#: Null and empty texts, copies, a near copy, repeated lines, a long text, a null id, a repeated id, clashing columns.
ROWS = [
    (1, "Line that repeats here\n" + BASE, "en"),
    (2, BASE, "de"),
    (3, None, "en"),
    (4, "", None),
    (5, BASE, "de"),
    (6, BASE + " ending", "de"),
    (7, "line THAT repeats here  \nown words of seven", "en"),
    (8, "Released under the MIT\nLicense. mail a.b@c.example.org, 10.0.0.1 or +1 (538) 555-4734", "en"),
    (9, "lorem " * 3000, "en"),
    (9, "zzz", "en"),
    (None, "card 4111 1111 1111 1111 and 4111111111111112", "en"),
    (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en"),
    (12, "12345 !!", "en"),
]
KEPT = {i: t or "" for i, t, _ in ROWS if not (i == 9 and t == "zzz")}


def docs(spark, rows=ROWS):
    extra = [(i, t, g, "s", 0, "x", 1, "y") for i, t, g in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, fingerprint string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_line_dedup(spark):
    got = by_id(dedup_lines(docs(spark)))
    assert set(got) == set(KEPT)
    assert got[7]["kept_text"] == "own words of seven" and got[7]["n_dropped"] == 1 and got[7]["n_lines"] == 2
    assert got[1]["kept_text"] == KEPT[1] and got[2]["kept_text"] == "" and got[2]["n_lines"] == 1
    assert dedup_lines(docs(spark).limit(0)).count() == 0
    assert by_id(dedup_lines(docs(spark), min_docs=4))[7]["n_dropped"] == 0


def test_fingerprints(spark):
    got = by_id(fingerprint_neighbours(docs(spark)))
    order = sorted(KEPT, key=lambda i: (i is not None, i or 0))
    for i, d in enumerate(order):
        text, after = KEPT[d], KEPT[order[(i + 1) % len(order)]]
        cut = len(text) // 4
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(text), sha(text[: len(text) - cut] + after[:cut]))
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[2]["fingerprint"] == got[5]["fingerprint"] != got[11]["fingerprint"]
    assert fingerprint_neighbours(docs(spark).limit(0)).count() == 0


def test_licenses(spark):
    got = by_id(license_scan(docs(spark)))
    assert [(p["start"], p["label"]) for p in got[8]["places"]] == [(1, "mit")]
    assert not any(r["places"] or r["blocks"] for d, r in got.items() if d != 8)
    assert {d: r["n_words"] for d, r in got.items()} == {d: len(WORD.findall(t.translate(UP))) for d, t in KEPT.items()}
    assert license_scan(docs(spark).limit(0)).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "Beta gamma, delta epsilon zeta eta theta iota"), (2, "eta THETA"), (3, None), (4, "...")], "item_id long, text string")
    got = by_id(contamination(docs(spark), items))
    assert got[11]["items"] == [1, 2] and got[11]["n_hit"] == 8 and got[11]["n_words"] == 10
    assert all(not r["items"] for d, r in got.items() if d != 11)
    cut = contamination(docs(spark), items).filter("doc_id = 11").select(without_spans(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert cut == "alpha kappa"
    assert by_id(contamination(docs(spark), items.limit(0)))[11]["n_hit"] == 0


def test_tokens_and_packing(spark):
    rng = random.Random(3)
    signs = [chr(i) for i in [*range(9, 14), *range(32, 127), *range(0xA0, 0x180)]] + list("–—‘’“”…€''sstm")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> it's", "İΣ x", ""]
    own = word_ids(None)
    assert own.ids(texts) == own.whole(texts)
    rows = pack(docs(spark), limit=64).collect()
    for d, t in KEPT.items():
        ids = own.whole([t])[0] + b"\0\0\0\0"
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in mine] == [(k // 4, len(ids[k : k + 256]) // 4, zlib.crc32(ids[k : k + 256])) for k in range(0, len(ids), 256)]
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0] + [n for _, n in sorted(places)])[:-1]) and sum(n for _, n in places) <= 64
    assert pack(docs(spark).limit(0)).count() == 0


def test_near_duplicates(spark):
    got = {d: r["class_id"] for d, r in by_id(near_duplicates(docs(spark))).items()}
    assert got[2] == got[5] == got[6] == got[1] == 1 and got[3] == got[4] == 3
    assert all(got[d] == d for d in (7, 8, 9, 11, 12))
    assert near_duplicates(docs(spark).limit(0)).count() == 0


def test_probability_likeness():
    a, b = Counter("aabbbc"), Counter("abbcd")
    keys = sorted(set(a) | set(b))
    want = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in keys if a[i] and b[i])
    num = lambda c: (np.array([ord(x) for x in sorted(c)], "<u4"), np.array([c[x] for x in sorted(c)], "<u4"))
    assert abs(likeness(*num(a), *num(b)) - want) < 1e-12


def test_personal_data(spark):
    out = personal_data(docs(spark)).select("doc_id", listed(F.col("spans")).alias("l"), redacted(F.col("text"), F.col("spans")).alias("r"))
    got = {r["doc_id"]: (r["l"], r["r"]) for r in out.collect()}
    text = KEPT[8]
    at = lambda s: f"{text.index(s)}:{text.index(s) + len(s)}"
    assert got[8][0] == f"email:{at('a.b@c.example.org')},ip:{at('10.0.0.1')},phone:{at('+1 (538) 555-4734')}"
    assert got[None][0] == "card:5:24" and got[None][1].startswith("card [CARD] and")
    assert all(not v[0] for d, v in got.items() if d not in (8, None))
    assert personal_data(docs(spark).limit(0)).count() == 0


def test_language_gradients_and_edges(spark):
    net = Network(["a", "b", "c"], units=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(97, 110, (6, 5)).astype(np.uint8)
    both, y = np.stack([x, x[::-1]]), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(net.run(both)[0])[y, :, np.arange(5)]).mean()
    for name, g in net.gradients(both, y).items():
        i = np.unravel_index(np.argmax(abs(g)), g.shape)
        old = net.p[name][i]
        net.p[name][i] = old + 1e-4
        up = loss()
        net.p[name][i] = old - 1e-4
        down = loss()
        net.p[name][i] = old
        assert abs((up - down) / 2e-4 - g[i]) < 1e-5
    got = by_id(identify(docs(spark)))
    assert {got[d]["lang_pred"] for d in (3, 4, 12)} == {"und"} and got[2]["lang_pred"] in ("de", "en")
    assert all(r["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1) for d, r in got.items())
    assert identify(docs(spark).limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()


def test_class_model(spark):
    got = by_id(score_documents(docs(spark)))
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", t.translate(UP)) + [None] for d, t in KEPT.items()}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d in KEPT}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
        assert r["score"] < 0
    assert score_documents(docs(spark).limit(0)).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header>Site</header><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>First  long\nparagraph of text<p>Second one, <b>bold</b>&nbsp;too<aside>side</aside></article><section id=comments><p>A reader says much more than the article does, on and on</p></section><footer>&copy; x</footer></body></html>"
    assert main_text(page) == "Head & more\nFirst long paragraph of text\nSecond one, bold too"
    plain = "<body><div class=menu><a href=a>one</a> <a href=b>two</a></div><div id=main><h2>Name</h2><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p></div><div class='cookie notice'>We use cookies</div></body>"
    assert main_text(plain).startswith("Name\nlong text") and "cookies" not in main_text(plain) and "one" not in main_text(plain)
    rows = spark.createDataFrame([(1, "u", page, "z"), (1, "u", page, "z"), (None, None, None, None), (3, "v", "", "")], "page_id long, url string, html string, text string")
    got = extract(rows).collect()
    assert len(got) == 4 and [r["n_chars"] for r in got if r["page_id"] != 1] == [0, 0]
    assert extract(rows.limit(0)).count() == 0
