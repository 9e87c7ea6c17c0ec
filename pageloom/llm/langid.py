"""Language identification by n-gram filters that answer for all languages at once.

A Bloom filter for each language, all of one size and with the same hashes, is
stored as bit slices: position ``p`` holds one mask with a bit for each
language. The masks at an n-gram's positions, and-ed, are the languages whose
filter has it. A text's n-grams are so looked up once for all languages; for
each language the share of n-grams it has, less the share its filter would
claim by chance, decides.

An n-gram is ``GRAM`` bytes of lowered letters, with one space for whatever
lies between words. A language's filter holds those that make at least
``LEAST_SHARE`` of its sample, so it has at most ``1 / LEAST_SHARE`` of them.

Training reads a bounded sample: about ``SAMPLE`` documents of each language,
chosen by a hash of the key, or all of a language with fewer.

Defined results: ``und`` and score 0 for a null text, one without letters, and
any text if there is nothing to learn from; a text too short for an n-gram is
padded by spaces. A text of which no n-gram is known gets the usual language,
score 0; equal shares go to the language first in order. Languages are
the non-null values of ``lang``; others than text and these are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrays import mix, slices, text_buffer
from pageloom.llm.tables import bare, packed, unpacked
from pageloom.llm.tokens import let_go

GRAM = 5  # bytes
SAMPLE = 4000  # documents of each language
LEAST_SHARE = 2e-5
POSITIONS = 1 << 19  # of each filter
HASHES = 3
UNKNOWN = "und"
TELLING = 50  # n-grams
LEAST_SCORE = 0.1

_SPACE = 32
_LETTERS = np.full(256, _SPACE, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    """The bit slices (one row of masks for each 64 languages) and how often each filter errs."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    usual: int = 0


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and the text each is of."""
    buffer, borders = text_buffer(texts)
    # A space before and after each text, then runs of spaces become one.
    n = len(borders) - 1
    padded = np.full(len(buffer) + 2 * n, _SPACE, np.uint8)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(borders) + 2)
    padded[np.arange(len(buffer)) + np.repeat(2 * np.arange(n) + 1, np.diff(borders))] = _LETTERS[buffer]
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE) | (of[1:] != of[:-1])
    padded, of = padded[keep].astype(np.uint64), of[keep]
    m = max(0, len(padded) - GRAM + 1)
    gram = np.zeros(m, np.uint64)
    for j in range(GRAM):
        gram |= padded[j: j + m] << np.uint64(8 * j)
    inside = of[:m] == of[GRAM - 1: GRAM - 1 + m] if m else np.zeros(0, bool)
    return gram[inside], of[:m][inside]


def _positions(gram: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        low = mix(gram)
        step = (low >> np.uint64(32)) | np.uint64(1)
        return [((low + np.uint64(i) * step) % np.uint64(POSITIONS)).astype(np.int64) for i in range(HASHES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each n-gram is in the texts of each language of a batch."""
    let_go()
    for batch in batches:
        for part in slices(batch, "text"):
            languages = part.column("lang").dictionary_encode()
            gram, of = _grams(part.column("text"))
            number = languages.indices.to_numpy(zero_copy_only=False)[of]
            for k, name in enumerate(languages.dictionary.to_pylist()):
                values, counts = np.unique(gram[number == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages of ``docs``, learnt from a bounded sample of them."""
    known = bare(docs, key, text, lang).toDF("key", "text", "lang").filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1, POSITIONS), np.uint64), np.zeros(0))
    grain = 1 << 30
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(grain, grain * SAMPLE // n)))])
    sample = known.filter(F.pmod(F.xxhash64("key"), F.lit(grain)) < F.element_at(share, F.col("lang"))).select("text", "lang")
    counts = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # At most 1 / LEAST_SHARE rows of each language, whatever the corpus.
    chosen = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * LEAST_SHARE).select("lang", "gram").toPandas()
    languages = sorted(sizes)
    masks = np.zeros((len(languages) // 64 + 1, POSITIONS), np.uint64)
    for k, name in enumerate(languages):
        for at in _positions(chosen.gram[chosen.lang == name].to_numpy(np.int64).view(np.uint64)):
            masks[k // 64, at] |= np.uint64(1 << (k % 64))
    fill = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / POSITIONS for k in range(len(languages))])
    return Model(languages, masks, fill ** HASHES, max(range(len(languages)), key=lambda k: sizes[languages[k]]))


def _has_letters(texts: pa.Array) -> np.ndarray:
    buffer, borders = text_buffer(texts)
    plain = (_LETTERS[buffer] != _SPACE) & (buffer < 0x80)
    sums = np.concatenate([[0], np.cumsum(plain)])
    out = sums[borders[1:]] > sums[borders[:-1]]
    for i in np.flatnonzero(~out & (np.diff(borders) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def _judged(batches: Iterator[pa.RecordBatch], text: str, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    let_go()
    model: Model = unpacked(shared)
    for batch in batches:
        for part in slices(batch, text):
            n = part.num_rows
            gram, of = _grams(part.column(text))
            at = _positions(gram)
            total = np.maximum(1, np.bincount(of, minlength=n))
            best, winner = np.full(n, -1.0), np.zeros(n, np.int64)
            for block, masks in enumerate(model.masks):
                found = masks[at[0]]
                for more in at[1:]:
                    found &= masks[more]
                for k in range(64 * block, min(64 * block + 64, len(model.languages))):
                    hits = np.bincount(of, (found >> np.uint64(k % 64) & np.uint64(1)).astype(np.float64), minlength=n)
                    share = (hits / total - model.chance[k]) / max(1e-9, 1 - model.chance[k])
                    better = share > best
                    best[better], winner[better] = share[better], k
            winner[best <= 0] = model.usual
            sure = _has_letters(part.column(text)) & (len(model.languages) > 0)
            names = np.array([*model.languages, UNKNOWN], object)
            prediction = names[np.where(sure, winner, len(model.languages))]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(prediction, pa.string()), pa.array(np.where(sure, np.clip(best, 0, 1), 0.0)),
                 pa.array(np.bincount(of, minlength=n).astype(np.int64))], names=[*part.schema.names, "lang_pred", "score", "n_grams"])


def _identified(docs: DataFrame, model: Model, columns: list[str], text: str) -> DataFrame:
    """Some columns under names of their own (``c0``, ...), so that none clashes, and what is found."""
    shared = packed(docs.sparkSession, model)
    read = bare(docs, *columns).toDF(*[f"c{i}" for i in range(len(columns))])
    at = f"c{columns.index(text)}"
    shape = ", ".join([f"c{i} {read.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(columns))] + ["lang_pred string, score double, n_grams long"])
    return read.mapInArrow(lambda it: _judged(it, at, shared), shape)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` and ``n_grams`` for every whole text.

    What is broadcast has the size of the model: ``POSITIONS`` masks for each 64 languages.
    """
    columns = list(dict.fromkeys([*keep, text]))
    out = _identified(docs, model, columns, text)
    return out.select(*[F.col(f"c{columns.index(c)}").alias(c) for c in keep], "lang_pred", "score", "n_grams")


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not :func:`rejected`."""
    out = _identified(docs, model, docs.columns, text).filter(~rejected())
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def rejected() -> Column:
    """Whether a judged text is in none of the languages: no letters, or n-grams enough to tell of which few are known."""
    return (F.col("lang_pred") == UNKNOWN) | ((F.col("n_grams") >= TELLING) & (F.col("score") < LEAST_SCORE))


def held_out(key: Column | str = "doc_id") -> Column:
    """Whether a document is kept from training."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
