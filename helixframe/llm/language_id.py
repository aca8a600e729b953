"""Operator 4, language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes.  In each, one gated recurrent layer runs forwards and
one backwards; their states label every position, and a document's probabilities are the mean over
all its positions.  Gates and candidate use the soft sign x / (1 + |x|), which is a few vector
operations.  The network is trained here, in numpy, by backpropagation through time (Adam on the
cross-entropy of every position), on a bounded sample: of every language at most SAMPLE_PER_LANGUAGE
documents (fewer where there are so many languages that this makes more than SAMPLE in all, but one at
least), and of each a window of SAMPLE_CHARS characters at a place given by its hash.  Prediction reads whole texts, never the
columns lang, source or doc_id.

Cases: a null text, an empty one or one without a letter gets ``und`` with score 0.  Repeated rows
give one row each.  An empty table gives an empty result; without any labelled row for training
every prediction is ``und``.  Further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

SEGMENT, HIDDEN = 128, 8
SAMPLE, SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 32_768, 512, 1024
STEPS, BATCH, TRAIN_BYTES, RATE = 240, 192, 64, 0.02
#: Segments that run side by side.
LANES = 8192
FOLDS = 5


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def new_model(n: int, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    """For both directions: input table of each byte's share in update gate, reset gate and
    candidate; recurrent weights of the three; and the label weights."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    m = {"bias": np.zeros(n, np.float32)}
    for d in "fb":
        m |= {f"in_{d}": draw(256, 3 * hidden), f"rec_{d}": draw(hidden, 3 * hidden), f"out_{d}": draw(hidden, n)}
    return m


def _run(table: np.ndarray, rec: np.ndarray, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
    """States after each row of x (time, lane)."""
    hidden = rec.shape[0]
    h = np.zeros((x.shape[1], hidden), np.float32)
    for row in x:
        a, g = table[row], h @ rec
        s = _squash(a[:, : 2 * hidden] + g[:, : 2 * hidden])
        gate = 0.5 * s + 0.5
        u, r = gate[:, :hidden], gate[:, hidden:]
        pre = a[:, 2 * hidden :] + r * g[:, 2 * hidden :]
        c = _squash(pre)
        if keep is not None:
            keep.append((row, h, s, u, r, g[:, 2 * hidden :], c))
        h = h + u * (c - h)
        yield h


def _gradient(m: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions of x (time, lane) with lane labels y, and gradients."""
    steps, lanes = x.shape
    kept = {"f": [], "b": []}
    states = {d: list(_run(m[f"in_{d}"], m[f"rec_{d}"], x if d == "f" else x[::-1], kept[d])) for d in "fb"}
    hf, hb = np.stack(states["f"]), np.stack(states["b"][::-1])
    logits = hf @ m["out_f"] + hb @ m["out_b"] + m["bias"]
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    loss = -float(np.log(p[:, np.arange(lanes), y] + 1e-9).mean())
    p[:, np.arange(lanes), y] -= 1
    p /= steps * lanes
    grad = {"bias": p.sum((0, 1)), "out_f": np.einsum("tlh,tln->hn", hf, p), "out_b": np.einsum("tlh,tln->hn", hb, p)}
    for d in "fb":
        rec, hidden = m[f"rec_{d}"], m[f"rec_{d}"].shape[0]
        into = (p if d == "f" else p[::-1]) @ m[f"out_{d}"].T
        g_in, g_rec, dh = np.zeros_like(m[f"in_{d}"]), np.zeros_like(rec), np.zeros((lanes, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            row, h, s, u, r, gc, c = kept[d][t]
            dh = dh + into[t]
            dpre = dh * u * (1 - np.abs(c)) ** 2  # the soft sign's slope is (1 - |output|)^2
            dgate = np.concatenate([dh * (c - h), dpre * gc], 1) * 0.5 * (1 - np.abs(s)) ** 2
            da = np.concatenate([dgate, dpre], 1)
            dg = np.concatenate([dgate, dpre * r], 1)
            np.add.at(g_in, row, da)
            g_rec += h.T @ dg
            dh = dh * (1 - u) + dg @ rec.T
        grad |= {f"in_{d}": g_in, f"rec_{d}": g_rec}
    return loss, grad


def train(texts: list[bytes], labels: np.ndarray, n: int, steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    """A model for labels 0..n-1; batches draw languages evenly and places at random."""
    rng, m = np.random.default_rng(seed), new_model(n, seed=seed)
    by = [np.flatnonzero(labels == k) for k in range(n)]
    mean, square = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, n, BATCH)
        x = np.full((TRAIN_BYTES, BATCH), 0x20, np.uint8)
        for lane, k in enumerate(y):
            text = texts[by[k][rng.integers(len(by[k]))]]
            at = rng.integers(max(1, len(text) - TRAIN_BYTES + 1))
            piece = np.frombuffer(text[at : at + TRAIN_BYTES], np.uint8)
            x[: len(piece), lane] = piece
        _, grad = _gradient(m, x, y)
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            m[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return m


def pooled(m: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the position probabilities, share of positions labelled with each language) of each
    document; whole texts."""
    n_docs, n = len(offsets) - 1, len(m["bias"])
    sums, votes = np.zeros((n_docs, n)), np.zeros((n_docs, n))
    sizes = np.diff(offsets)
    per = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(n_docs), per)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT + offsets[:-1][owner]
    size = np.minimum(offsets[1:][owner] - begin, SEGMENT)
    for at in range(0, len(owner), LANES):
        o, b, s = owner[at : at + LANES], begin[at : at + LANES], size[at : at + LANES]
        place = np.arange(SEGMENT)[:, None]
        x = np.where(place < s, data[np.minimum(b + place, len(data) - 1)], 0x20).astype(np.uint8)
        forwards = np.empty((SEGMENT, len(o), n), np.float32)
        for t, h in enumerate(_run(m["in_f"], m["rec_f"], x)):
            np.matmul(h, m["out_f"], out=forwards[t])
        total, count = np.zeros((len(o), n), np.float32), np.zeros((len(o), n), np.float32)
        for t, h in zip(range(SEGMENT - 1, -1, -1), _run(m["in_b"], m["rec_b"], x[::-1]), strict=True):
            p = h @ m["out_b"]
            p += forwards[t]
            p += m["bias"]
            best = p.max(1, keepdims=True)
            inside = (t < s)[:, None]
            count += (p == best) & inside
            p -= best
            np.exp(p, out=p)
            p /= p.sum(1, keepdims=True)
            p *= inside
            total += p
        for out, part in ((sums, total), (votes, count)):
            for k in range(n):
                out[:, k] += np.bincount(o, weights=part[:, k], minlength=n_docs)
    size = np.maximum(sizes, 1)[:, None]
    return sums / size, votes / size


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[dict | None, list[str]]:
    """Model and languages from the rows that are not held out."""
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    d = d.filter(~held_out("i")).filter("l IS NOT NULL AND t IS NOT NULL AND l <> 'und'").withColumn("h", F.xxhash64("i", "t"))
    n_languages = d.select(F.count_distinct("l")).first()[0]
    slots_each = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE // max(1, n_languages)))
    # one document for each language and slot, the least by hash: folded in the map tasks
    window = F.expr(f"substring(t, 1 + CAST(pmod(h, greatest(length(t) - {SAMPLE_CHARS}, 1)) AS INT), {SAMPLE_CHARS})")
    slots = d.select("l", F.pmod(F.xxhash64("h"), F.lit(slots_each)).alias("slot"), F.struct("h", window.alias("w")).alias("s"))
    per = slots.groupBy("l", "slot").agg(F.min("s").alias("s"))
    by = per.groupBy("l").agg(F.sort_array(F.collect_list("s.w")).alias("w"))
    rows = sorted((r["l"], [w.encode() for w in r["w"] if w.strip()]) for r in by.collect())
    rows = [(lang, w) for lang, w in rows if w]
    if not rows:
        return None, []
    labels = np.concatenate([np.full(len(w), k) for k, (_, w) in enumerate(rows)])
    return train([x for _, w in rows for x in w], labels, len(rows)), [lang for lang, _ in rows]


def _predict(m: dict | None, languages: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.text_batches(batches, text_col):
            texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
            letters = np.array([any(map(str.isalpha, t or "")) for t in texts])
            if m is None:
                lang, score, share = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                p, votes = pooled(m, data, offsets)
                best = p.argmax(1)
                at = np.arange(len(texts))
                lang = [languages[k] if has else "und" for k, has in zip(best.tolist(), letters.tolist(), strict=True)]
                score, share = np.where(letters, np.minimum(p[at, best], 1.0), 0.0), np.where(letters, votes[at, best], 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang), pa.array(score), pa.array(share)], [*rows.schema.names, "_lang_pred", "_score", "_position_share"])

    return run


def identify(docs: DataFrame, model: dict | None, languages: list[str], text_col: str = "text") -> DataFrame:
    """docs with _lang_pred, _score (pooled probability) and _position_share (of the positions, those
    labelled so); columns of those names are replaced."""
    d = docs.drop("_lang_pred", "_score", "_position_share")
    schema = StructType(list(d.schema.fields))
    for name, kind in (("_lang_pred", "string"), ("_score", "double"), ("_position_share", "double")):
        schema = schema.add(name, kind)
    return d.mapInArrow(_predict(model, languages, text_col), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model, languages = fit(docs)
    found = identify(docs.select("doc_id", "text"), model, languages)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_position_share").alias("position_share"))
