"""Language identification with interpolated Kneser-Ney character models.

Counts of character n-grams per language are gathered by Spark from a bounded,
documented sample of labelled rows. Each language's interpolated probabilities are
worked out once for every n-gram seen and kept in one sorted array of n-gram
hashes with a column per language, so scoring a text is a sorted lookup per
character. The language with the lowest cross-entropy per character wins; a
document is rejected where even the best language fits it far worse than its own
held-back sample fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shipped, written
from .textbytes import chunks, mix

ORDER = 4
#: No code point from here on is a letter.
_LIMIT = 0x3FFFF


def _code_map() -> np.ndarray:
    """Code point to lower-cased letter, or a blank for what is no letter."""
    out = np.full(_LIMIT + 1, 32, dtype=np.uint32)
    for c in range(_LIMIT):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_CODES: list[np.ndarray] = []


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a chunk as the models see them, and the row of each.

    Letters are lower-cased, runs of other characters are one blank, and every row
    begins with a blank.
    """
    if not _CODES:
        _CODES.append(_code_map())
    first = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.r_[0, np.cumsum(first)][offsets]  # row offsets in code points
    chars = _CODES[0][np.minimum(codes, _LIMIT)]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    blank = chars == 32
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (rows[1:] == rows[:-1]))
    starts = at[:-1][np.diff(at) > 0]
    keep[starts[blank[starts]]] = False
    chars, rows = chars[keep], rows[keep]
    begin = np.searchsorted(rows, np.arange(len(offsets) - 1))
    return np.insert(chars, begin, 32), np.insert(rows, begin, np.arange(len(offsets) - 1))


_MULT = [np.uint64(pow(0x9FB21C651E98DF25, k, 1 << 64)) for k in range(16)]


def gram_keys(chars: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order the hash of the n characters that end at each place; 0
    where the row has fewer before it. Keys of different n differ."""
    wide, out = chars.astype(np.uint64), []
    total = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, order + 1):
        k = n - 1
        total = total.copy()
        if k:
            total[k:] += wide[:-k] * _MULT[k]
            same = np.zeros(len(chars), dtype=bool)
            same[k:] = rows[k:] == rows[:-k]
        else:
            total += wide
            same = np.ones(len(chars), dtype=bool)
        out.append(np.where(same, mix(total + np.uint64(n * 0x2545F4914F6CDD1D % (1 << 64))) | np.uint64(1), np.uint64(0)))
    return out


@dataclass
class LanguageModel:
    """Sorted n-gram hashes with a column of log probabilities per language.

    `keys` has the n-grams of every order; `logp[i, l]` is language l's log
    probability of the last character of n-gram i given those before it, already
    interpolated with the lower orders; `backoff[i, l]` is the log weight of the
    lower order after n-gram i as context. `unseen[l]` holds for a character never
    seen. `centre` is each language's median cross-entropy on rows that its counts
    don't hold, and `limit` how far above it a text of that language may lie;
    `sharpness` turns margins into probabilities.
    """

    languages: list[str]
    order: int
    keys: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    unseen: np.ndarray
    centre: np.ndarray
    limit: np.ndarray
    sharpness: float = 1.0

    def cross_entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (rows by languages) and the characters counted."""
        n = len(offsets) - 1
        chars, rows = letters(data, offsets)
        out = np.zeros((n, len(self.languages)))
        counts = np.bincount(rows, minlength=n) - 1
        letters_in = np.bincount(rows[chars != 32], minlength=n)
        if not letters_in.any() or not self.languages:
            return out, letters_in
        grams = gram_keys(chars, rows, self.order)
        score = np.zeros((len(chars), len(self.languages)), dtype=np.float32)
        todo = np.flatnonzero(np.r_[False, rows[1:] == rows[:-1]])  # the leading blank predicts, but isn't predicted
        for n in range(self.order, 0, -1):
            i, hit = self._find(grams[n - 1][todo])
            score[todo[hit]] += self.logp[i[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                i, known = self._find(grams[n - 2][todo - 1])
                score[todo[known]] += self.backoff[i[known]]
        score[todo] += self.unseen
        ends = np.r_[np.flatnonzero(rows[1:] != rows[:-1]) + 1, len(rows)]
        sums = np.add.reduceat(score.astype(np.float64), np.r_[0, ends[:-1]], axis=0)
        out[rows[np.r_[0, ends[:-1]]]] = -sums / np.maximum(counts[rows[np.r_[0, ends[:-1]]]], 1)[:, None]
        return out, letters_in

    def _find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return i, self.keys[i] == want

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: none), confidence, whether the text lies beyond the
        language's limit, and letters."""
        h, n_letters = self.cross_entropy(data, offsets)
        if not self.languages:
            none = np.zeros(len(h))
            return np.full(len(h), -1), none, n_letters == 0, n_letters
        best = h.argmin(axis=1)
        margin = (h - h.min(axis=1, keepdims=True)) * np.sqrt(np.minimum(n_letters, 400))[:, None] * self.sharpness
        score = 1 / np.exp(-np.minimum(margin, 700)).sum(axis=1)
        odd = _excess(h[np.arange(len(h)), best], self.centre[best], n_letters) > self.limit[best]
        none = n_letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), odd | none, n_letters


def _excess(h: np.ndarray, centre: np.ndarray, n_letters: np.ndarray) -> np.ndarray:
    """Cross-entropy above the centre, as for a text of 400 letters: short texts stray
    further by chance, by the square root of their length."""
    return (h - centre) * np.sqrt(np.minimum(n_letters, 400) / 400)


def reject_limit(own: np.ndarray, foreign: np.ndarray, false_reject: float, missed: float = 0.05, tail: float = 0.2) -> float:
    """Above which excess a text is rejected, from the excesses of held-back texts of
    the language and of texts of other languages.

    The own limit leaves `false_reject` of the language's texts above it; as so small
    a share is rarer than the sample shows, the upper `tail` of it is continued as an
    exponential. Where foreign texts lie higher, it is raised as far as `1 - missed`
    of these are still rejected, so that clean texts have all the room there is.
    """
    if len(own) < 5:
        return np.inf
    start = np.quantile(own, 1 - tail)
    above = own[own > start] - start
    limit = start + (above.mean() if len(above) else 0.0) * np.log(max(tail / false_reject, 1.0))
    return float(max(limit, np.quantile(foreign, missed)) if len(foreign) >= 5 else limit)


def _probabilities(grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], order: int, discount: float = 0.75) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Interpolated Kneser-Ney for one language.

    grams[n] has, sorted by key: key, context key (the first n-1 characters),
    suffix key (the last n-1) and count. The highest order uses counts, lower ones
    the number of different characters seen before (continuation counts). Returns
    all keys with their log probabilities, the contexts with their log weights of
    the lower order, and the log probability of an unseen character.
    """
    use = {order: grams[order][3].astype(np.float64)}
    for n in range(order - 1, 0, -1):
        keys = grams[n][0]
        kinds = np.zeros(len(keys))
        np.add.at(kinds, np.searchsorted(keys, grams[n + 1][2]), 1)
        use[n] = np.maximum(kinds, 1)
    total, vocabulary = use[1].sum(), len(use[1])
    base = discount * vocabulary / total / (vocabulary + 1)
    below_keys, below = grams[1][0], np.maximum(use[1] - discount, 0) / total + base
    keys_out, p_out, contexts, weights = [below_keys], [below], [], []
    for n in range(2, order + 1):
        keys, context, suffix, _ = grams[n]
        ctx, where = np.unique(context, return_inverse=True)
        mass = np.bincount(where, weights=use[n])
        weight = discount * np.bincount(where) / mass
        p = np.maximum(use[n] - discount, 0) / mass[where] + weight[where] * below[np.searchsorted(below_keys, suffix)]
        keys_out.append(keys)
        p_out.append(p)
        contexts.append(ctx)
        weights.append(weight)
        below_keys, below = keys, p
    return np.concatenate(keys_out), np.log(np.concatenate(p_out)), np.concatenate(contexts), np.log(np.concatenate(weights)), float(np.log(base))


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, n, key, context, suffix, count), added up per chunk."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, data, offsets in chunks(batch.column(1)):
            chars, rows = letters(data, offsets)
            grams = gram_keys(chars, rows, order)
            inner = np.r_[False, rows[1:] == rows[:-1]]
            names = np.array(langs[a:b], dtype=object)
            for lang in dict.fromkeys(names):
                mine = inner & (names == lang)[rows]
                for n in range(1, order + 1):
                    ok = mine & (grams[n - 1] != 0)
                    at = np.flatnonzero(ok)
                    keys, first, counts = np.unique(grams[n - 1][at], return_index=True, return_counts=True)
                    at = at[first]
                    zero = np.zeros(len(at), dtype=np.uint64)
                    context = grams[n - 2][at - 1] if n > 1 else zero
                    suffix = grams[n - 2][at] if n > 1 else zero
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, dtype=np.int32)), *(pa.array(x.view(np.int64)) for x in (keys, context, suffix)), pa.array(counts)],
                        names=["lang", "n", "key", "context", "suffix", "count"],
                    )


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, docs_per_language: int = 400, false_reject: float = 1e-4) -> LanguageModel:
    """Fits the models to a bounded sample: `docs_per_language` whole documents of
    each non-null language, those with the smallest hash of id and text, of which
    every fourth is held back from the counts to calibrate.

    `false_reject` is the share of a language's own texts that its limit may cut off
    (see reject_limit). Every n-gram of the sample is kept; those rows bound them. Languages are columns
    of the table, so they are meant to be few (a label set). With no labelled row
    there is no language, and every prediction is none.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    # the smallest hashes of each language, found without its texts: a bounded aggregate
    hashes = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), h.alias("h"))
    n_rows = hashes.groupBy("lang").count().collect()  # one row per language
    if not n_rows:
        return LanguageModel([], order, np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0), np.zeros(0))
    keep = F.lit(False)
    for r in n_rows:  # a first cut by hash leaves about twice the sample, so the window below sees few rows
        share = min(1.0, 2.0 * docs_per_language / r["count"])
        keep = keep | ((F.col("lang") == r["lang"]) & (F.pmod(F.col("h"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    sample = (
        labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
        .where(F.col("text").isNotNull() & keep)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 20)), "h")))
        .where(F.col("rank") <= docs_per_language)
    )
    sample = written(sample.select("lang", "text", (F.col("rank") % 4 == 0).alias("back")), "langid_sample")
    counted = sample.where("not back").select("lang", "text").mapInArrow(lambda it: _counted(it, order), "lang string, n int, key long, context long, suffix long, count long")
    summed = counted.groupBy("lang", "n", "key").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("count").alias("count"))
    got = summed.select("lang", "n", "key", "context", "suffix", "count").toArrow().to_pandas()
    languages, parts, unseen = sorted(got["lang"].unique()), [], []
    for lang in languages:
        grams = {}
        for n in range(1, order + 1):
            g = got[(got["lang"] == lang) & (got["n"] == n)]
            cols = [g[c].to_numpy().view(np.uint64) for c in ("key", "context", "suffix")]
            by = np.argsort(cols[0])
            grams[n] = (*(c[by] for c in cols), g["count"].to_numpy()[by])
        *fitted, low = _probabilities(grams, order)
        parts.append(fitted)
        unseen.append(low)
    model = _merge(languages, order, parts, np.array(unseen), got)
    return _calibrate(model, sample.where("back"), false_reject)


def _merge(languages: list[str], order: int, parts: list[list[np.ndarray]], unseen: np.ndarray, got) -> LanguageModel:
    """One sorted array for all languages. A language that lacks an n-gram takes its
    value of the next shorter one, times the weight its context leaves for that."""
    keys, first = np.unique(got["key"].to_numpy().view(np.uint64), return_index=True)
    order_of = got["n"].to_numpy()[first]
    context, suffix = (got[c].to_numpy().view(np.uint64)[first] for c in ("context", "suffix"))
    logp = np.full((len(keys), len(languages)), np.nan, dtype=np.float32)
    backoff = np.zeros((len(keys), len(languages)), dtype=np.float32)
    for l, (k, p, c, w) in enumerate(parts):
        logp[np.searchsorted(keys, k), l] = p
        at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
        known = keys[at] == c
        backoff[at[known], l] = w[known]
    for n in range(1, order + 1):
        rows = np.flatnonzero(order_of == n)
        at = np.minimum(np.searchsorted(keys, context[rows]), len(keys) - 1)
        left = np.where((keys[at] == context[rows])[:, None], backoff[at], 0)
        for l in range(len(languages)):
            gap = np.isnan(logp[rows, l])
            logp[rows[gap], l] = unseen[l] if n == 1 else left[gap, l] + logp[np.searchsorted(keys, suffix[rows[gap]]), l]
    return LanguageModel(languages, order, keys, logp, backoff, unseen.astype(np.float32), np.zeros(len(languages)), np.full(len(languages), np.inf))


def _calibrate(model: LanguageModel, held: DataFrame, false_reject: float) -> LanguageModel:
    """Centre and limit of each language's cross-entropy, and the sharpness that
    makes the probabilities of held-back rows most likely.

    What texts of an unknown language look like is seen on each language in turn:
    its held-back rows go to the best of the other languages.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                h, n = model.cross_entropy(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=["lang", "h", "n"])

    got = held.select("lang", "text").mapInArrow(measure, "lang string, h array<double>, n long").toArrow().to_pandas()
    got = got[got["n"] > 0]
    index = {x: i for i, x in enumerate(model.languages)}
    got = got[got["lang"].isin(index)]
    if not len(got):
        return model
    h, own, n = np.stack(got["h"].to_numpy()), got["lang"].map(index).to_numpy(), got["n"].to_numpy()
    for l in range(len(model.languages)):
        if (own == l).sum() >= 5:
            model.centre[l] = np.median(h[own == l, l])
    others = np.where(np.arange(len(model.languages))[None, :] == own[:, None], np.inf, h)
    other = others.argmin(axis=1)
    away = _excess(others.min(axis=1), model.centre[other], n)
    sure = h.argmin(axis=1) == own  # a wrong label makes a text of one language look like a foreign one of another
    long = sure & np.isfinite(away) & (n >= 400)  # shorter ones are too few letters to tell
    for l in range(len(model.languages)):
        here = long & (other == l)
        model.limit[l] = reject_limit(_excess(h[sure & (own == l), l], model.centre[l], n[sure & (own == l)]), away[here if here.sum() >= 20 else long], false_reject)
    margin = (h - h.min(axis=1, keepdims=True)) * np.sqrt(np.minimum(n, 400))[:, None]
    best, least = 1.0, np.inf
    for s in np.geomspace(0.05, 20, 40):
        loss = np.mean(np.log(np.exp(-np.minimum(margin * s, 700)).sum(axis=1)) + margin[np.arange(len(own)), own] * s)
        if loss < least - 1e-9:
            best, least = float(s), loss
    model.sharpness = best
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and lang_rejected to docs, in place of columns
    of these names.

    Null texts and texts without a letter are `und` with score 0 and rejected. A
    text is also rejected where its cross-entropy lies further above that of its
    language's own texts than the limit found on held-back rows. Every row is scored by
    itself, so repeated rows, ties (the first language in code point order) and
    empty tables need no care; very long texts are scored whole.
    """
    docs = docs.drop("lang_pred", "score", "lang_rejected")
    sent = shipped(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            done = [m.predict(data, offsets) for _, _, data, offsets in chunks(batch.column(at), 1 << 19)]
            pick, score, odd = (np.concatenate([d[k] for d in done]) if done else np.zeros(0) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[pick.astype(int)], pa.string()), pa.array(score.astype(np.float64)), pa.array(odd.astype(bool))],
                names=[*columns, "lang_pred", "score", "lang_rejected"],
            )

    return docs.mapInArrow(run, schema)
