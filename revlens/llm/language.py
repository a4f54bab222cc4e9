"""Language identification by compression.

Per language a zstandard raw-content dictionary is cut from a bounded sample of its
labelled texts.  A text is compressed window by window with every dictionary; the
language whose dictionary gives the smallest total wins.  The margin to the runner-up
decides whether the answer is trusted (``rejected``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import released, text_batches

UND = "und"
TRAIN_DOCS = 64            # documented bound: rows sampled for each language, whole texts
TRAIN_CHARS = 6_000        # texts up to this length are sampled first
WINDOW = 800               # characters compressed at once
LEVEL = 6                  # lower levels pass over the short matches that tell close languages apart
MOST_LANGUAGES = 1_000
_NOT_LETTERS = regex.compile(r"\P{L}+")


def normalize(text: str) -> str:
    """Lower-cased letters, every run of other characters one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id",
          train_docs: int = TRAIN_DOCS) -> dict[str, bytes]:
    """``{language: dictionary}`` from rows with a language and a text.

    At most ``train_docs`` rows of each language, those of up to ``TRAIN_CHARS`` characters
    first, in the order of a hash of ``order_col`` and the length, so the sample is bounded
    and the same on every run; the sample alone reaches the driver.  The dictionary is made
    of the whole texts sampled.  Null languages or texts are left out.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(order_col).cast("string"), F.length(text_col)).alias("k"),
        (F.length(text_col) > TRAIN_CHARS).cast("int").alias("long"), F.col(text_col).cast("string").alias("t"))
    picked = _first_k(rows, train_docs)
    out: dict[str, bytes] = {}
    for r in picked.limit(MOST_LANGUAGES + 1).collect():
        texts = [normalize(x["t"]) for x in r["s"]]
        data = " ".join(t for t in texts if t).encode("utf-8", "surrogatepass")
        if data:
            out[r["lang"]] = data
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return out


def _first_k(rows: DataFrame, k: int) -> DataFrame:
    """Rows of the k smallest keys of each language: every input partition keeps k at
    most (window group limit) before the shuffle."""
    from pyspark.sql.window import Window
    w = Window.partitionBy("lang").orderBy("long", "k", "t")
    return (rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "t"))).alias("s")))


class Model:
    """Compressors of all languages; built once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compress = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each language."""
        total = [0] * len(self.langs)
        for at in range(0, len(text), WINDOW):
            data = text[at:at + WINDOW].encode("utf-8", "surrogatepass")
            for k, f in enumerate(self.compress):
                total[k] += len(f(data))
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); margin is the relative gap to the runner-up and
        score maps it to 0..1.  ``und`` for null, for no letter and without languages."""
        t = normalize(text) if text else ""
        if not t or not self.langs:
            return UND, 0.0, 0.0
        sizes = self.sizes(t)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.langs[k]))
        rest = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        return self.langs[best], min(1.0, margin / (margin + 0.02)) if margin > 0 else 0.0, margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.01) -> Column:
    """Column ``struct(lang, score, margin, rejected)`` for ``df``'s text.

    ``lang`` is the nearest language, ``rejected`` tells that the margin is below
    ``min_margin`` (ties have margin 0 and go to the first language by name).  Null
    texts and texts without a letter give ``und``, score 0, rejected.
    """
    if sum(map(len, dictionaries.values())) > 256 << 20:
        raise ValueError("dictionaries too large to ship to executors")
    text_batches(df)
    shipped = df.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("lang string, score double, margin double, rejected boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(shipped.value)
        for texts in released(batches):
            got = [model.predict(t.as_py()) for t in texts]
            columns = {"lang": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "margin": pa.array([g[2] for g in got], pa.float64()),
                       "rejected": pa.array([g[0] == UND or g[2] < min_margin for g in got], pa.bool_())}
            yield pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    return run(F.col(text_col).cast("string"))
