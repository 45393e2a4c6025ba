"""Language identification by hierarchical discrimination.

Linear support vector machines, one for each pair, first choose among language families, then among the
languages of the chosen family; most wins take it, and margins break ties. Inputs are hashed byte 1- to
4-grams of the whole lower-cased text. The machines are fitted on at most SAMPLE rows per language, fewer
where more than TOTAL / SAMPLE languages occur, taken in order of the hash of id and text; every language
that occurs is learned, and everything else reads every row.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that the machines are fitted on: per language, and of all languages together (one each at least).
SAMPLE = 800
TOTAL = 64 * SAMPLE
BUCKETS = 1 << 12
UNKNOWN = "und"
#: Scores under this are rejected by accepted(). A language that wins all its machines scores 0.25 or more, so
#: in effect only texts without letters go; text of a language that was not learned stays.
MIN_SCORE = 0.2
# Families of common languages by ISO 639-1 code; any other language is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "celtic": "br cy ga gd", "baltic": "lt lv", "uralic": "et fi hu", "turkic": "az kk ky tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur", "iranian": "fa ku ps tg", "semitic": "ar he mt am",
    "austronesian": "id jv mg ms su tl", "dravidian": "kn ml ta te",
}
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte n-gram counts."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    code, parts = b, [(b * np.uint32(2654435761)) >> np.uint32(20)]
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        parts.append((code * np.uint32(2654435761)) >> np.uint32(20))
    x = np.sqrt(np.bincount(np.concatenate(parts), minlength=BUCKETS)).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_machine(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Linear support vector machine by averaged subgradients; y is -1 or 1, both sides weigh the same."""
    w, b, mean_w, mean_b = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for t in range(rounds):
        inside = (y * (x @ w + b) < 1) * weight * y
        step = 20 / (1 + 0.05 * t)
        w = w * (1 - step * strength) + step * (inside @ x)
        b += 0.1 * step * inside.sum()
        if t >= rounds // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    n = rounds - rounds // 2
    return mean_w / n, float(mean_b / n)


class Choice:
    """One-versus-one machines among names."""

    def __init__(self, names: list[str], x: np.ndarray, of: np.ndarray):
        self.names, self.pairs = names, list(itertools.combinations(range(len(names)), 2))
        fitted = []
        for i, j in self.pairs:
            rows = np.isin(of, [names[i], names[j]])
            own = x if rows.all() else x[rows]  # not copied where there are but two
            fitted.append(fit_machine(own, np.where(of[rows] == names[i], 1, -1).astype(np.float32)))
        self.w = np.array([w for w, _ in fitted], np.float32).reshape(len(fitted), x.shape[1])
        self.b = np.array([b for _, b in fitted], np.float32)

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The name and its weakest probability against any other."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        wins, total, weakest = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (i, j), m in zip(self.pairs, (self.w @ x + self.b).tolist()):
            wins[i if m >= 0 else j] += 1
            for k, own in ((i, m), (j, -m)):
                total[k] += own
                weakest[k] = min(weakest[k], own)
        best = max(range(len(self.names)), key=lambda k: (wins[k], total[k], -k))
        return self.names[best], float(1 / (1 + np.exp(-4 * np.clip(weakest[best], -20, 20))))


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family = np.array([family_of(s) for s in lang], object)
        self.families = Choice(sorted(set(family)), x, family) if len(lang) else None
        self.languages = {f: Choice(sorted(set(lang[family == f])), x[family == f], lang[family == f]) for f in set(family)}

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or self.families is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, p = self.families.choose(x)
        lang, q = self.languages[family].choose(x)
        return lang, p * q


def _remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def held_out(id_col: str = "doc_id") -> Column:
    return _remainder(id_col, 4) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Reads text and lang of the rows that are not held out; only features of the sample are gathered."""
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().collect()
    most = max(1, min(SAMPLE, TOTAL // max(1, len(counts))))
    # per language about four times the sample by a threshold on the hash, then the lowest hashes of these
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 4 * most / n)) for lang, n in counts], "lang string, share double")
    keyed = known.withColumn("key", F.xxhash64("id", "text")).join(F.broadcast(shares), "lang")
    drawn = keyed.filter(F.col("key").cast("double") / 2.0**64 + 0.5 <= F.col("share")).select("lang", "key", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    last = drawn.select("lang", "key").withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("lang").agg(F.max("key").alias("last")).collect()
    last = docs.sparkSession.createDataFrame([tuple(r) for r in last], "lang string, last long")
    drawn = drawn.join(F.broadcast(last), "lang").filter(F.col("key") <= F.col("last")).select("lang", "key", "text")
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}
        for b in batches:
            for lang, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                best.setdefault(lang, []).append((key, text))
            best = {k: sorted(v)[:most] for k, v in best.items()}
        rows = [(lang, key, zlib.compress(features(text).astype(np.float16).tobytes(), 1)) for lang, v in best.items() for key, text in v]
        if rows:
            yield common.batch(dict(zip(schema.names, zip(*rows))), schema)

    common.ship(docs.sparkSession)
    rows: dict[str, list] = {}
    for r in drawn.mapInArrow(common.lean(run), "lang string, key long, x binary").collect():
        rows.setdefault(r["lang"], []).append(r)
    # equal rows share a hash
    gathered = [r for lang in sorted(rows) for r in sorted(rows[lang], key=lambda r: (r["key"], r["x"]))[:most]]
    x = np.empty((len(gathered), BUCKETS), np.float32)
    for own, r in zip(x, gathered):
        own[:] = np.frombuffer(zlib.decompress(r["x"]), np.float16)
    return Model(x, np.array([r["lang"] for r in gathered], object))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score per row.

    A null text, a text without a letter, and any text when there was nothing to learn from, is `und`
    with score 0. Repeated rows are predicted alike; a null id hashes as the empty string; an empty table
    gives no rows. Only text enters a prediction.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col, lang_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that are `und` or score under min_score; lang becomes the prediction.

    So null, empty and letterless texts go, and every row where no label is left to learn from. Repeated rows
    are decided alike; a null id is an id; an empty table gives no rows. Other columns may have any names and
    are kept.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    at_text, at_lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column(at_text)]
            columns = list(b.columns)
            columns[at_lang] = pa.array([f[0] for f in found], columns[at_lang].type)
            keep = pa.array([f[0] != UNKNOWN and f[1] >= min_score for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return common.plain_names(docs).mapInArrow(common.lean(run), docs.schema)
