"""Language identification by rank-order profiles (operator 4).

Method: a text's letters, lower-cased, with every run of other characters as one space, give n-grams
of one to three characters (without a space inside). A language's profile is its ``top`` most
frequent n-grams over all its learning texts, in order; a document's profile likewise. The
out-of-place distance sums, over the document's n-grams, how far their ranks are apart in the two
profiles (``top`` for those that are missing); the nearest language is predicted.

The score is 1 - distance / (greatest possible distance), between 0 and 1.

Counts of learning texts are added up in each task and then by key; the profiles (``top`` n-grams a
language) are all that comes to the driver, and are broadcast. Texts are not shuffled.

Cases: null texts and texts without a letter are ``und`` with score 0; ties between n-grams go to the
smaller one, ties between languages to the name that sorts first; learning rows without a language
or text don't count; without any learning text all is ``und``; an empty table gives an empty result;
repeated rows are predicted apart; a text longer than ``PART`` is counted in parts at spaces, with the
same n-grams; extra columns are kept, but for those that bear a result's name (see ``names``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.textops import slices
from siftline.session import ship

TOP = 300
PART = 1 << 18  # bytes of text whose n-grams are held at once
UND = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 where it is no letter."""
    if not _letters:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (three code points of 21 bits, shorter ones with zeros in front) and their rows."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.array([len(t) + 2 for t in texts])
    points = letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    solid = points != 32
    keep = solid.copy()
    keep[0] = True
    keep[1:] |= solid[:-1]
    points, row, solid = points[keep], row[keep], solid[keep]
    two = solid[:-1] | solid[1:]
    three = solid[1:-1]
    return (
        np.concatenate([points[solid], (points[:-1] << 21 | points[1:])[two], (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[three]]),
        np.concatenate([row[solid], np.where(solid[:-1], row[:-1], row[1:])[two], row[1:-1][three]]),
    )


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about PART bytes that begin at an ASCII space or line end, where n-grams
    of the parts are those of the whole. A word longer than that stays whole."""
    breaks = np.flatnonzero((data == 32) | (data == 10))
    at = 0
    while at < len(data):
        place = np.searchsorted(breaks, at + PART)
        end = int(breaks[place]) if place < len(breaks) else len(data)
        yield data[at:end]
        at = end


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct n-grams in order, and how often they occur."""
    if len(offsets) == 2 and len(data) > PART:
        yield summed([np.unique(grams(part, np.array([0, len(part)]))[0], return_counts=True) for part in pieces(data)])
        return
    gram, row = grams(data, offsets)
    order = np.argsort(row, kind="stable")
    gram, at = gram[order], np.searchsorted(row[order], np.arange(len(offsets)))
    for a, b in zip(at[:-1], at[1:]):
        yield np.unique(gram[a:b], return_counts=True)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """Each language's profile: its ``top`` n-grams, most frequent first."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        for batch in batches:
            for rows, data, offsets in slices(batch, 0, PART):
                lang = np.array(rows.column(1).to_pylist(), object)
                if len(lang) == 1 and len(data) > PART:
                    found = {lang[0]: next(counted(data, offsets))}
                else:
                    gram, row = grams(data, offsets)
                    found = {name: np.unique(gram[(lang == name)[row]], return_counts=True) for name in set(lang)}
                for name, pair in found.items():
                    own = counts.setdefault(name, [])
                    own.append(pair)
                    if len(own) > 16:
                        own[:] = [summed(own)]
        for name, own in counts.items():
            gram, n = summed(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    by_task = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("__text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, gram bigint, n bigint")
    total = by_task.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("rank", rank).where(F.col("rank") <= top).toPandas().sort_values(["lang", "rank"])
    return {name: part["gram"].to_numpy() for name, part in rows.groupby("lang")}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", top: int = TOP, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all, unless given) with the language and the score under ``names``; columns
    of ``docs`` with one of these names (in any case of letters) are left out."""
    spark = docs.sparkSession
    ship(spark)
    langs = sorted(profiles)
    vocabulary = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(vocabulary) + 1, len(langs)), -1, np.int64)
    for j, name in enumerate(langs):
        ranks[np.searchsorted(vocabulary, profiles[name]), j] = np.arange(len(profiles[name]))
    held = spark.sparkContext.broadcast((langs, vocabulary, ranks))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    place_of_text = kept.index(text_col) if text_col in kept else len(kept)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vocabulary, ranks = held.value
        for batch in batches:
            for rows, data, offsets in slices(batch, place_of_text, PART):
                lang, score = [], []
                for gram, n in counted(data, offsets):
                    if not len(gram) or not langs:
                        lang.append(UND)
                        score.append(0.0)
                        continue
                    own = gram[np.argsort(-n, kind="stable")[:top]]
                    place = np.searchsorted(vocabulary, own)
                    place[vocabulary[np.minimum(place, len(vocabulary) - 1)] != own] = len(vocabulary)
                    found = ranks[place]
                    away = np.where(found < 0, top, np.abs(found - np.arange(len(own))[:, None])).sum(0)
                    best = int(away.argmin())
                    lang.append(langs[best])
                    score.append(1 - away[best] / (top * len(own)))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{names[0]}` string, `{names[1]}` double"])
    return docs.select(*kept, *[text_col] * (text_col not in kept)).mapInArrow(run, schema)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
