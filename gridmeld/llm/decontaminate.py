"""Benchmark decontamination by template canonicalisation.

Texts become templates: words are lower-cased and stripped of punctuation, and
numbers, units after numbers and names become typed slots: capitalised words inside
a sentence, and in a further reading those that open one.
Windows of template words are hashed and joined with those of the benchmark. Where
other values fill the slots, they must agree along the alignment: the same value in
the item must always meet the same value in the document, so a re-parameterised
question is caught and an accidental mixture of windows isn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, written
from .textbytes import _GRAM, BYTE_VALUES, Powers, chunks, mix, span_hashes, word_spans

WINDOW = 5
#: So many windows along an alignment let those with only two words that are no slots count.
LINE = 3
#: So many windows in a row that stand literally in a document are reported whatever their share: 13 words.
RUN = 9
#: Words that are units when they follow a number.
UNITS = """
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years
usd eur gbp dollar dollars cent cents euro euros percent degree degrees kmh mph w kw kwh v a hz khz mhz ghz kb mb gb tb
""".split()
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".!?:;\n\r\""]] = True


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_DIGIT, _CAPITAL, _SMALL = _byte_class((48, 57)), _byte_class((65, 90)), _byte_class((97, 122), (0x80, 0xFF))
_LETTER = _byte_class((48, 57), (65, 90), (97, 122), (0x80, 0xFF))


def _unit_hashes() -> np.ndarray:
    pw, out = Powers(), []
    for u in UNITS:
        x = np.frombuffer(u.encode(), np.uint8)
        out.append(span_hashes(BYTE_VALUES[x], np.array([0]), np.array([len(x)]), pw)[0])
    return np.sort(np.array(out, dtype=np.uint64))


_UNIT_HASHES = _unit_hashes()


def _lowered(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a string column with their lower-cased bytes, of the same offsets."""
    for a, b, data, offsets in chunks(column):
        low = data.copy()
        low[_CAPITAL[data]] += 32
        if (data >= 0xC4).any() and (data >= 0xC4)[(data != 0xE2)].any():
            text = data.tobytes().decode("utf-8", "replace")
            other = text.lower().encode()
            if len(other) != len(data):  # a capital whose small letter has another length stays
                other = "".join(c if len(c.encode()) != len(x.encode()) else x for c in text for x in [c.lower()]).encode()
            low = np.frombuffer(other, np.uint8)
        after = np.r_[False, data[:-1] == 0xC3] & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = np.where(after, data + 32, low).astype(np.uint8)
        yield a, b, data, low, offsets


class Template:
    """The template words of a chunk: a hash in each reading (the word itself, numbers
    and units as slots, names as slots too, capitalised words that open a sentence
    as names), which are slots, and where they stand."""

    def __init__(self, data: np.ndarray, low: np.ndarray, offsets: np.ndarray, pw: Powers) -> None:
        word = _LETTER[data]
        general = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else np.zeros(0, int)
        for k in range(3):  # general punctuation: quotes, dashes, wide blanks
            word[general + k] = False
        latin = np.flatnonzero(data[:-1] == 0xC2)
        word[latin] = word[latin + 1] = False
        digit = _DIGIT[data]
        inner = np.zeros(len(data), dtype=bool)
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        word |= inner
        numeric = np.r_[0, np.cumsum(digit | inner)]
        self.starts, self.ends, self.rows = self._split(*word_spans(data, offsets, word), numeric)
        self.data = data
        self.pw = pw
        self.literal = hashes = span_hashes(BYTE_VALUES[low], self.starts, self.ends, pw)
        n = len(hashes)
        number = numeric[self.ends] - numeric[self.starts] == self.ends - self.starts
        joined = np.r_[False, self.rows[1:] == self.rows[:-1]] if n else np.zeros(0, bool)
        after_number = joined & np.r_[False, number[:-1]] if n else joined
        unit = after_number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)] == hashes)
        stops = np.r_[0, np.cumsum(_STOP[data])]
        inside = joined & (stops[self.starts] == stops[np.r_[0, self.ends[:-1]]]) if n else joined
        capital = self._capitalised(low) & ~unit
        self.name, self.opening = inside & capital, ~inside & capital
        self.slot = number | unit
        self.plain = np.where(number, _NUMBER, np.where(unit, _UNIT, hashes))
        self.named = np.where(self.name, _NAME, self.plain)
        self.every = np.where(capital, _NAME, self.plain)

    @staticmethod
    def _split(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, numeric: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cuts words like 30km into the number and the letters."""
        other = np.flatnonzero(np.diff(numeric) == 0)
        if not len(other) or not len(starts):
            return starts, ends, rows
        cut = other[np.minimum(np.searchsorted(other, starts), len(other) - 1)]
        at = np.flatnonzero((cut > starts) & (cut < ends) & (numeric[ends] == numeric[np.minimum(cut, ends)]))
        return np.insert(starts, at + 1, cut[at]), np.insert(ends, at, cut[at]), np.insert(rows, at, rows[at])

    def _capitalised(self, low: np.ndarray) -> np.ndarray:
        """Which words are a capital of any script and then a letter that is none."""
        if not len(self.starts):
            return np.zeros(0, dtype=bool)
        changed = np.r_[0, np.cumsum(low != self.data)]
        end = lambda at: np.minimum(at + 1 + (self.data[at] >= 0xC2) + (self.data[at] >= 0xE0) + (self.data[at] >= 0xF0), len(self.data))
        second = end(self.starts)
        more = second < self.ends
        second = np.where(more, second, self.starts)
        third = end(second)
        return more & (changed[second] > changed[self.starts]) & (changed[third] == changed[second]) & _SMALL[self.data[second]]

    def windows(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(first word, hash, which are solid, which words are slots, whether thin) of the
        windows of n words in each reading: all of the literal one, and of the others
        those with a slot and at least three words which are none. Solid windows are
        those that a reading with slots has, too, or would have if they held one. Where
        capitalised words that open a sentence are names as well, windows with two
        words that are no slots come as thin ones."""
        size = max(len(self.rows) - n + 1, 0)
        first = np.flatnonzero(self.rows[:size] == self.rows[n - 1 : n - 1 + size])
        held = lambda mask: (c := np.r_[0, np.cumsum(mask)])[first + n] - c[first]
        slots, names, openings = held(self.slot), held(self.name), held(self.opening)
        rest = n - slots - names - openings
        most = self.slot | self.name | self.opening
        solid = (slots == 0) | (n - slots >= 3)
        every = np.ones(len(first), dtype=bool)
        for hashes, mask, ok, thin in (
            (self.literal, np.zeros(len(self.rows), dtype=bool), every, False),
            (self.plain, self.slot, (slots > 0) & (n - slots >= 3), False),
            (self.named, self.slot | self.name, (names > 0) & (n - slots - names >= 3), False),
            (self.every, most, (openings > 0) & (rest >= 3), False),
            (self.every, most, (rest < n) & (rest == 2), True),
        ):
            at, keys = first[ok], np.zeros(int(ok.sum()), dtype=np.uint64)
            for k in range(n):
                keys += hashes[at + k] * np.uint64(_GRAM[k])
            yield at, mix(keys), solid[ok], mask, thin

    def wordless(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each row that has numbers and units only, as a whole."""
        rows, first, size = np.unique(self.rows, return_index=True, return_counts=True)
        words = np.bincount(self.rows, weights=~self.slot, minlength=1)[rows] == 0
        return first[words], mix(span_hashes(self.literal, first[words], first[words] + size[words], self.pw) ^ _NUMBER)

    def fill(self, word: int, n: int, mask: np.ndarray) -> list[str] | None:
        """What fills the slots of a window, in order."""
        out = [self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace") for k in range(word, word + n) if mask[k]]
        return out or None


def _counts_up(words: list[str]) -> bool:
    """Numbers that go on by one same step, as in an enumeration, whatever units stand among them."""
    try:
        values = [float(w.replace(",", "")) for w in words if any(c.isdigit() for c in w)]
    except ValueError:
        return False
    return len({round(b - a, 9) for a, b in zip(values, values[1:])}) <= 1


def template_windows(df: DataFrame, window: int = WINDOW, bitmap: np.ndarray | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(id, text) to (id, total, firm, size, pos, key, solid, thin, fill): the windows of each
    text, whose whole number is total and that of solid ones firm; with a bitmap only
    those that it lets pass. Null is an empty text. A text shorter than the window has
    one window of its own size. With `sizes` each text has windows of all these sizes.
    A text of numbers and units only has its whole as a window (of size -1), and with
    `sizes`, or where it is as long as a window and doesn't just count, its literal ones, too."""
    sent = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, low, offsets in _lowered(batch.column(1)):
                t = Template(data, low, offsets, pw)
                if not len(t.rows):
                    continue
                words = np.bincount(t.rows, minlength=b - a)
                begin = np.searchsorted(t.rows, np.arange(b - a))
                first, keys = t.wordless()
                bare = np.zeros(b - a, dtype=bool)
                bare[t.rows[first]] = True
                text_of = lambda w, size: [t.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(t.starts[w : w + size], t.ends[w : w + size])]  # noqa: B023, E731
                cut = np.zeros(b - a, dtype=bool)  # texts of numbers that are matched by windows
                if not sizes:
                    cut[[r for w in first.tolist() if words[r := t.rows[w]] >= window and not _counts_up(text_of(w, int(words[r])))]] = True
                firm = np.zeros(b - a, dtype=np.int64)
                found = [(first, keys, np.zeros(len(first), dtype=bool), np.zeros(len(t.rows), dtype=bool), False, 0)]
                for n in sizes or range(1, window + 1):
                    mine = None if sizes else (np.minimum(words, window) == n) & (~bare | cut)
                    if mine is not None and not mine.any():
                        continue
                    for k, (at, keys, solid, mask, thin) in enumerate(t.windows(n)):
                        if mine is not None:
                            own = mine[t.rows[at]]
                            at, keys, solid = at[own], keys[own], solid[own]
                        if not k:
                            firm += np.bincount(t.rows[at[solid]], minlength=b - a)
                        found.append((at, keys, solid, mask, thin, n))
                total = np.where(bare & ~cut, 1, np.maximum(words - window + 1, 1))
                for at, keys, solid, mask, thin, n in found:
                    if sent is not None:
                        hit = in_bitmap(sent.value, keys)
                        at, keys, solid = at[hit], keys[hit], solid[hit]
                    rows = t.rows[at]
                    fills = [t.fill(w, n, mask) for w in at.tolist()] if mask.any() else [None] * len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(rows + a)), pa.array(total[rows]), pa.array(firm[rows]), pa.array(np.full(len(at), n or -1)), pa.array((at - begin[rows]).astype(np.int64)), pa.array(keys.view(np.int64)),
                            pa.array(solid), pa.array(np.full(len(at), thin)), pa.array(fills, pa.list_(pa.string())),
                        ],
                        names=["id", "total", "firm", "size", "pos", "key", "solid", "thin", "fill"],
                    )

    return df.mapInArrow(run, "id long, total long, firm long, size long, pos long, key long, solid boolean, thin boolean, fill array<string>")


def _longest_run(windows: Column) -> Column:
    """The most windows of an alignment that follow one another and stand literally in the document."""
    places = F.array_sort(F.transform(F.filter(windows, lambda w: w["equal"]), lambda w: w["item_pos"]))
    step = lambda acc, p: F.struct(p.alias("last"), F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(1).alias("now"), F.greatest(acc["most"], F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(1)).alias("most"))
    return F.when(F.size(windows) >= RUN, F.aggregate(places, F.struct(F.lit(-9).cast("long").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])).otherwise(0)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """(id_col, item_col, n_windows, matched, coverage, kind): a row for each document
    and item where at least the share `coverage` of the item's windows stands in the
    document, or at least 13 words in a row do literally. A window with other values in its slots counts only where each of the
    item's values that it holds meets one value along the alignment; windows that
    stand there literally always count. kind is `verbatim` where every counted window
    stands literally in the document, `word` for an item of one word, else `reparameterised`.

    Documents meet a fixed-size bitmap of the items' windows first and are joined
    with the windows exactly afterwards, so a large benchmark costs no broadcast and
    a common window no gathering. Windows are judged per alignment (the distance of
    positions), so a document may hold several variants of one item.

    Windows are read literally, numbers and units as plain words, and as templates,
    which need three words that are no slots, or two where at least three windows stand
    along the alignment. Numbers joined to letters are two words. The share is taken of all windows, or of
    those that can be templates where that share is larger.

    Defined cases: null, empty and wordless texts and items match nothing; an item
    shorter than a window has one window, its whole, which stands anywhere in a
    document, so an item of one word is in each document with that word, which the kind
    `word` tells apart; an item of numbers and units only is matched by its literal windows, or, where it is shorter
    than a window or goes on by one same step, by an equal text only, as counting isn't copying;
    ids are integers, and rows that share an id (null too) are judged as one
    document; repeated items give a row each only where their ids differ.
    Extra columns aren't read. Empty tables give no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    windows = written(template_windows(bench, window), "windows").select(F.col("id").alias("item"), F.col("total").alias("n_windows"), "firm", "size", F.col("pos").alias("item_pos"), "key", "solid", "thin", F.col("fill").alias("want"), (F.col("size") == 1).alias("word"))
    sizes = sorted(r["size"] for r in windows.select("size").where(f"size between 1 and {window}").distinct().collect()) or [window]
    hits = template_windows(slim, window, bitmap_of(windows.select("key"), "key"), sizes).select("id", "pos", "key", "fill")
    pairs = hits.join(windows, "key").select("id", "item", "n_windows", "firm", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "solid", "thin", "word", *[F.transform(c, F.lower).alias(c) for c in ("want", "fill")])
    pairs = written(pairs, "matches")
    same = ["id", "item", "n_windows", "shift"]
    filled = pairs.where("want is not null").select(*same, F.explode(F.arrays_zip("want", "fill")).alias("s")).select(*same, "s.want", "s.fill")
    clash = filled.groupBy(*same, "want").agg(F.min("fill").alias("lo"), F.max("fill").alias("hi")).where("lo <> hi")
    clash = clash.groupBy(*same).agg(F.collect_set("want").alias("clash")).select(*[F.col(c).alias(f"s_{c}") for c in same], "clash")
    on = pairs["id"].eqNullSafe(clash["s_id"]) & pairs["item"].eqNullSafe(clash["s_item"]) & (pairs["n_windows"] == clash["s_n_windows"]) & (pairs["shift"] == clash["s_shift"])
    equal = F.coalesce(F.col("want") == F.col("fill"), F.lit(True))
    judged = pairs.join(clash, on, "left").withColumn("equal", equal).where(F.col("equal") | F.col("clash").isNull() | ~F.arrays_overlap("want", "clash"))
    line = ["id", "item", "n_windows", "firm", "word"]
    judged = judged.groupBy(*line, "shift", "item_pos").agg(F.bool_or("equal").alias("equal"), F.bool_or("solid").alias("solid"), F.bool_and("thin").alias("thin"))
    judged = judged.groupBy(*line, "shift").agg(F.collect_list(F.struct("item_pos", "equal", "solid", "thin")).alias("w"))
    judged = judged.select(*line, _longest_run(F.col("w")).alias("run"), F.inline(F.filter("w", lambda w: ~w["thin"] | w["equal"] | (F.size("w") >= LINE))))
    judged = judged.groupBy(*line, "item_pos").agg(F.bool_or("equal").alias("equal"), F.bool_or("solid").alias("solid"), F.max("run").alias("run"))
    found = judged.groupBy(*line).agg(F.count("*").alias("n"), F.count_if("solid").alias("n_solid"), F.bool_and("equal").alias("equal"), F.max("run").alias("run"))
    shares = [F.struct((m / t).alias("coverage"), t.alias("n_windows"), m.alias("matched")) for m, t in ((F.col("n"), F.col("n_windows")), (F.col("n_solid"), F.nullif("firm", F.lit(0))))]
    return (
        found.withColumn("best", F.when(F.col("firm") == 0, shares[0]).otherwise(F.greatest(*shares)))
        .where((F.col("best.coverage") >= coverage) | (F.col("run") >= RUN))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_windows", "best.matched", "best.coverage", F.when(F.col("word"), "word").when(F.col("equal"), "verbatim").otherwise("reparameterised").alias("kind"))
    )
