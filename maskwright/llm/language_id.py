"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskwright.llm.common import held_out, id_and_text, public_id, row_id, small_batches, text_blocks, unique_rows

#: Units a direction, bytes of a window, windows that run side by side.
UNITS, WINDOW, LANES = 12, 128, 1024
#: The fit uses at most PER_LANGUAGE documents of each language, the first by hash of doc_id, and of each SNIPPET code
#: points from a place that the hash chooses. Prediction reads whole texts.
PER_LANGUAGE, SNIPPET = 400, 400
STEPS, BATCH, SPAN, RATE, SEED = 400, 192, 40, 0.02, 7
UNKNOWN = "und"
#: Bytes of text that are predicted at once; a longer text is run whole.
BLOCK = 4 * LANES * WINDOW


class Network:
    """Two gated recurrent layers, one along the bytes and one against them, and a softmax at every position.

    Arrays are (2 directions, lanes, ...). Of a layer's 3U columns the first U are the update gate z, the next the
    reset gate r, the last the candidate: h' = z h + (1 - z) tanh(x + (r h) U).
    """

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        n = len(languages)
        self.p = {
            "E": rng.normal(0, 0.3, (2, 256, 3 * units)).astype(np.float32),
            "G": rng.normal(0, 0.5 / units**0.5, (2, units, 2 * units)).astype(np.float32),
            "C": rng.normal(0, 0.5 / units**0.5, (2, units, units)).astype(np.float32),
            "V": rng.normal(0, 0.3, (2, units, n)).astype(np.float32),
            "b": np.zeros(n, np.float32),
        }

    def run(self, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """States (2, T, lanes, U) for bytes x (2, T, lanes), the second direction reversed; and what the way back needs.

        The gates' halved inputs and the candidate's are looked up and multiplied as contiguous arrays of their own.
        """
        p, u = self.p, self.units
        steps, lanes = x.shape[1:]
        h = np.zeros((2, lanes, u), p["C"].dtype)
        cells = [np.ascontiguousarray(f * p["E"][..., k * u : k * u + u]) for k, f in ((0, 0.5), (1, 0.5), (2, 1))]
        gz, gr = np.ascontiguousarray(0.5 * p["G"][..., :u]), np.ascontiguousarray(0.5 * p["G"][..., u:])
        states, kept = np.empty((2, steps, lanes, u), h.dtype), []
        z, r, c = (np.empty_like(h) for _ in range(3))
        for t in range(steps):
            if keep:
                z, r, c = (np.empty_like(h) for _ in range(3))
            for k in (0, 1):
                for e, out in zip(cells, (z, r, c)):
                    np.take(e[k], x[k, t], axis=0, out=out[k], mode="clip")
            z += h @ gz
            np.tanh(z, out=z)
            r += h @ gr
            np.tanh(r, out=r)
            for gate in (z, r):
                gate += 1
                gate *= 0.5
            c += (r * h) @ p["C"]
            np.tanh(c, out=c)
            new = states[:, t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep:
                kept.append((h, z, r, c))
            h = np.ascontiguousarray(new)
        return states, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(languages, T, lanes) at each byte, from the state before and after it in both directions."""
        _, steps, lanes, u = states.shape
        sums = [states[k].reshape(-1, u) @ self.p["V"][k] for k in (0, 1)]
        n = sums[0].shape[1]
        logits = sums[0].T.reshape(n, steps, lanes) + sums[1].T.reshape(n, steps, lanes)[:, ::-1]
        logits += self.p["b"][:, None, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time. y: language of each lane."""
        p, u = self.p, self.units
        states, kept = self.run(x)
        d = np.ascontiguousarray(self.probabilities(states).transpose(1, 2, 0))
        steps, lanes = d.shape[:2]
        d[:, np.arange(lanes), y] -= 1
        d /= steps * lanes
        g = {k: np.zeros_like(v) for k, v in p.items()}
        both = (d, d[::-1])
        g["b"] = d.sum((0, 1))
        g["V"] = np.stack([np.einsum("tlu,tln->un", states[k], both[k]) for k in (0, 1)])
        back = np.zeros((2, lanes, u), np.float32)
        for t in reversed(range(steps)):
            h, z, r, c = kept[t]
            dh = back + np.stack([both[k][t] @ p["V"][k].T for k in (0, 1)])
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            drh = dc @ p["C"].transpose(0, 2, 1)
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr], -1)
            back = dh * z + drh * r + dg @ p["G"].transpose(0, 2, 1)
            g["C"] += (r * h).transpose(0, 2, 1) @ dc
            g["G"] += h.transpose(0, 2, 1) @ dg
            de = np.concatenate([dg, dc], -1)
            for k in (0, 1):
                order = np.argsort(x[k, t], kind="stable")
                own = x[k, t][order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                g["E"][k][own[first]] += np.add.reduceat(de[k][order], first, axis=0)
        return g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
        """Adam on random windows of the texts, each language as often as the others."""
        rng = np.random.default_rng(seed)
        by = [[t for t, k in zip(texts, labels) if k == n and t] for n in range(len(self.languages))]
        present = [n for n, own in enumerate(by) if own]
        if not present:
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.choice(present, BATCH)
            x = np.full((SPAN, BATCH), 0x20, np.uint8)
            for lane, n in enumerate(y.tolist()):
                text = by[n][rng.integers(len(by[n]))]
                at = int(rng.integers(max(1, len(text) - SPAN + 1)))
                own = text[at : at + SPAN]
                x[: len(own), lane] = np.frombuffer(own, np.uint8)
            g = self.gradients(np.stack([x, x[::-1]]), y)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean over all positions of a text; uniform for an empty one.

        Texts are cut into windows of WINDOW bytes, which cover them wholly and run LANES at a time.
        """
        n = len(self.languages)
        total = np.zeros((len(texts), n))
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), counts)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = offsets[doc] + inner * WINDOW
        size = np.minimum(offsets[doc + 1] - begin, WINDOW)
        buf = np.frombuffer(b"".join(texts) + b" " * WINDOW, np.uint8)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            steps = int(size[own].max())
            x = buf[begin[own][None, :] + np.arange(steps)[:, None]]
            inside = np.arange(steps)[:, None] < size[own][None, :]
            x = np.where(inside, x, 0x20)
            states, _ = self.run(np.stack([x, x[::-1]]), keep=False)
            np.add.at(total, doc[own], (self.probabilities(states) * inside).sum(1).T)
        return np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], 1 / max(n, 1))


def learn(docs: DataFrame, share: int = 3) -> Network:
    """Fits the network on a bounded sample of the labelled rows whose crc32(doc_id as text) mod share is not 1."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = unique_rows(own).withColumn("id", row_id())
    rows = own.filter("lang is not null and text is not null").filter(~held_out(share))
    mark = F.xxhash64("id")
    # the first by hash lie under a bound that leaves twice the sample of each language: only these meet in a task
    mark = F.shiftrightunsigned(mark, 2)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sizes:
        bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(2**62, int(2**62 * (2 * PER_LANGUAGE / n))))])
        rows = rows.filter(mark < F.try_element_at(bound, F.col("lang")))
    at = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - SNIPPET, F.lit(1)))
    snippets = rows.select("lang", mark.alias("mark"), "id", F.substr("text", (at + 1).cast("int"), F.lit(SNIPPET)).alias("text"))
    first = snippets.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("mark", "id"))).filter(F.col("place") <= PER_LANGUAGE)
    sample = sorted((r["lang"], r["place"], r["text"]) for r in first.select("lang", "place", "text").collect())
    languages = sorted({r[0] for r in sample})
    texts = [r[2].encode("utf-8", "replace") for r in sample]
    return Network(languages).fit(texts, [languages.index(r[0]) for r in sample])


def predicted(net: Network, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text."""
    languages, scores = [], []
    pooled = net.pooled(texts) if net.languages else np.zeros((len(texts), 0))
    for t, p in zip(texts, pooled):
        if len(p) and any(map(str.isalpha, t.decode("utf-8", "replace"))):
            k = int(np.argmax(p))
            languages.append(net.languages[k])
            scores.append(min(1.0, float(p[k])))
        else:
            languages.append(UNKNOWN)
            scores.append(0.0)
    return languages, scores


def _predict(model):
    def predict(batches):
        for rows, texts in text_blocks(batches, limit=BLOCK):
            languages, scores = predicted(model.value, texts)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return predict


def language_of(model, text: Column) -> Column:
    """A column (lang_pred, score) for a text column; model: a broadcast Network. Rows stay where they are."""

    @F.arrow_udf("struct<lang_pred string, score double>")
    def of(texts: pa.Array) -> pa.Array:
        languages, scores = [], []
        for _, own in text_blocks([pa.RecordBatch.from_arrays([texts], ["text"])], limit=BLOCK):
            found = predicted(model.value, own)
            languages += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, share: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of each whole text and its pooled probability.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod share is not 1, a bounded sample of
    them; a prediction reads text alone. A text that is null or has no letter is `und` with score 0, and so is every
    text where there is nothing to learn from. Ties go to the language that sorts first. A null doc_id is the text ''
    for the split; rows that share a doc_id count as one document, the one of least text. Extra columns are not read.
    An empty table gives no rows. Predictions need no shuffle; the model that is broadcast has a fixed size.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, share))
    base = id_and_text(docs)
    found = base.mapInArrow(_predict(model), "id long, lang_pred string, score double")
    return found.select(public_id().alias("doc_id"), held_out(share).alias("held_out"), "lang_pred", "score")
