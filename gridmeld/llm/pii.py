"""Personal data in texts: overlapping candidates, boosted trees, calibrated thresholds.

Everything that runs over the corpus is built-in column expressions. Patterns give
the base spans (validated e-mail and IP addresses, card and phone numbers), which
always stay. In what these leave of a text, further generators propose candidates
that may overlap: wide runs of digits, their parts at each separator, narrower number
shapes, and disguised addresses. Trees judge them by their format and context; those
beyond their kind's threshold are added, of overlapping ones the better.

The trees learn what the base patterns can't see: base spans of a bounded sample are
put back into their own contexts in a disguise (no plus sign, other separators, a
number next to them, "[at]" and "dot"), and a candidate that meets such a span exactly
is an example of its kind. All other candidates there and numbers of other sorts put
into the same contexts are examples of none. What the generators find in the sample's own
texts may be personal data that the base patterns miss, so it is unlabelled: first trees judge it,
and only what they find less likely than nearly all disguised spans is an example of
none for the trees that are used. Thresholds are set on held-back examples for a wanted precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import fresh, written

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. What stands before them only spares hopeless starts: a match that begins inside a run of its first class could begin at the run's start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs without which a pattern can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Wide runs of digits with up to two separators between them.
NUMBERS = r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){7,24}"
#: Narrower shapes, whose matches may lie inside those of NUMBERS or overlap them: single runs, groups of four or of 4-6-5, phone shapes, quads.
SHAPES = "|".join([
    r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[\x20.-]{1,2}[0-9]{4}){3}(?![0-9])",
    r"(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])",
    r"(?<![0-9])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?\.\x20?|\[\.\]|\(\.\)|-)[0-9]{1,3}){3}(?![0-9])",
])
ADDRESSES = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?:\x20?@\x20?|\x20?[\[({]at[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{2,63}(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,24}){1,4}"
#: Words whose nearness speaks for a kind.
CUES = {"phone": "phone|tel|call|mobile|fax|contact|whatsapp|sms|dial", "card": "card|visa|master|amex|credit|debit|payment|account|iban", "ip": "ip|host|server|address|ping|login|from", "email": "mail|contact|write|reach|send|address"}
_MARK, _OTHER, _MASK = "\u0001", "\u0002", "\u0003"
_BLOCK, _BEFORE, _AFTER = 64, 24, 12
_SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a name for the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches of a pattern, which have the odd places."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost and not overlapping, as an array of
    (s, e, m, b, a): start and end in code points, the match, and what stands
    before and after it (up to 24 and 12 code points).

    Marks are set around the matches and the text is cut there; the running sum of
    the pieces' lengths is kept per block of pieces, and contexts are taken from the
    pieces, so that the cost stays nearly linear in the text and the matches.
    """
    empty = F.array().cast(f"array<{_SPAN}>")

    def located(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.char_length(x))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
        blocks = lambda n: F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")),
            F.array(F.lit(0)),
            lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))),
        )
        at = lambda i: F.coalesce(F.get(p, i), F.lit(""))
        before = lambda i: F.right(F.concat(F.right(at(i - 2), F.lit(_BEFORE)), at(i - 1)), F.lit(_BEFORE))
        after = lambda i: F.left(F.concat(F.left(at(i + 1), F.lit(_AFTER)), F.left(at(i + 2), F.lit(_AFTER))), F.lit(_AFTER))

        def each(n: Column, off: Column) -> Column:
            def span(j: Column) -> Column:
                i = j * 2 + 1
                block = F.floor(i / _BLOCK).cast("int")
                start = F.get(off, block) + total(F.slice(n, block * _BLOCK + 1, i - block * _BLOCK))
                return _let(start, lambda s: F.struct(s.alias("s"), (s + F.get(n, i)).alias("e"), F.get(p, i).alias("m"), before(i).alias("b"), after(i).alias("a")))

            return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 3) / 2).cast("int")), span)

        return _let(sizes, lambda n: _let(blocks(n), lambda off: each(n, off)))

    return _let(_pieces(text, pattern), lambda p: F.when(F.size(p) < 3, empty).otherwise(located(p)))


def _masked(text: Column, kind: str) -> Column:
    """The text with the valid matches of a base pattern covered by as many mask signs."""
    cover = lambda x, i: F.when((i % 2 == 1) & _valid(kind, x), F.repeat(F.lit(_MASK), F.char_length(x))).otherwise(x)
    return F.array_join(F.transform(_pieces(text, PATTERNS[kind]), cover), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str) -> Callable[[Column], Column]:
    """A test of spans: whether a match of a base pattern passes its kind's."""
    return lambda c: _valid(kind, c["m"])


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\.", -1), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def with_base(docs: DataFrame, text_col: str, t: str) -> DataFrame:
    """Adds the columns t + text (null as empty, the marks replaced), t + base_<kind>,
    the valid spans of each kind, and t + rest, the text with these covered."""
    out = docs.withColumn(f"{t}text", F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK + _MASK, _OTHER * 2))
    out = out.withColumn(f"{t}digit", F.col(f"{t}text").rlike("[0-9]"))
    none = F.array().cast(f"array<{_SPAN}>")
    for kind in KINDS:
        may = F.contains(F.col(f"{t}text"), F.lit(NEEDS[kind])) & (F.lit(True) if kind == "email" else F.col(f"{t}digit"))
        found = F.when(may, spans(F.col(f"{t}text"), PATTERNS[kind])).otherwise(none)
        out = out.withColumn(f"{t}base_{kind}", F.filter(found, passes(kind)))
    rest = f"{t}text"
    for kind in ("email", "phone", "ip", "card"):
        now = f"{t}rest" if kind == "card" else f"{t}rest_{kind}"
        out = out.withColumn(now, F.when(F.size(f"{t}base_{kind}") > 0, _masked(F.col(rest), kind)).otherwise(F.col(rest)))
        rest = now
    return out


def _flag(x: Column) -> Column:
    return x.cast("double")


def _context(c: Column, cues: list[str]) -> list[Column]:
    before = F.lower(c["b"])
    return [*[_flag(before.rlike(CUES[k])) for k in cues], _flag(before.rlike(r"[a-z0-9]$")), _flag(before.rlike(r"[0-9][\x20().+-]{0,3}$")), _flag(before.rlike(r"\+$")), _flag(before.rlike(r"[=#_/:]\s?$")), _flag(c["a"].rlike(r"^[A-Za-z_]")), _flag(c["a"].rlike(r"^[\x20().-]{0,2}[0-9]"))]


def number_features(c: Column) -> Column:
    m = c["m"]

    def parts(groups: Column) -> Column:
        count = lambda sign: (F.length(m) - F.length(F.replace(m, F.lit(sign), F.lit("")))).cast("double")
        length = lambda g: _flag(F.length(g))
        digits = F.array_join(groups, "")
        quad = (F.size(groups) == 4) & F.forall(groups, lambda g: F.length(g) <= 3) & F.forall(groups, lambda g: F.coalesce(g.try_cast("int"), F.lit(999)) <= 255)
        return F.array(
            length(digits), _flag(F.size(groups)), _flag(F.array_max(F.transform(groups, F.length))), length(F.get(groups, F.lit(0))), length(F.element_at(groups, -1)), count("."), count("-"), count(" "), count("("),
            _flag(F.left(digits, F.lit(1))), _flag(F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)), _flag(quad), *_context(c, ["phone", "card", "ip"]),
        )

    return _let(F.filter(F.split(m, "[^0-9]+"), lambda g: g != ""), parts)


def address_features(c: Column) -> Column:
    m = c["m"]
    local = F.regexp_extract(m, r"^[A-Za-z0-9._%+-]+", 0)
    domain = F.regexp_extract(m, r"(?:@\x20?|[\])}]\x20?|\x20at\x20)([A-Za-z0-9-]+)", 1)
    last = F.regexp_extract(m, r"[A-Za-z0-9-]+$", 0)
    return F.array(
        _flag(F.length(local)), _flag(F.length(domain)), _flag(F.length(last)), _flag(local.rlike("[0-9]")), _flag(local.rlike(r"[._-]")), _flag(last.rlike("[0-9]")),
        _flag(F.lower(last).isin("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "example")), _flag(F.contains(m, F.lit("@"))), _flag(m.rlike(r"[\[({]at[\])}]")), _flag(m.rlike(r"[\[({]dot[\])}]|\x20dot\x20")),
        _flag(F.lower(domain) == "www"), *_context(c, ["email"]),
    )


def _cut(c: Column) -> Column:
    """The parts of a number before and after each of its separators, of eight digits or more."""
    m, digit = c["m"], lambda i: F.substring(c["m"], i, F.lit(1)).rlike("[0-9]")
    edges = F.filter(F.sequence(F.lit(1), F.char_length(m) - 1), lambda i: digit(i) != digit(i + 1))

    def parts(i: Column) -> Column:
        left, right = F.left(m, i), F.substring(m, i + 1, F.char_length(m))
        part = lambda s, e, x, b, a: F.struct(s.alias("s"), e.alias("e"), x.alias("m"), b.alias("b"), a.alias("a"))
        return F.when(digit(i), part(c["s"], c["s"] + i, left, c["b"], F.concat(right, c["a"]))).otherwise(part(c["s"] + i, c["e"], right, F.right(F.concat(c["b"], left), F.lit(_BEFORE)), c["a"]))

    return F.filter(F.transform(edges, parts), lambda x: F.length(_digits(x["m"])) >= 8)


def numbers(text: Column) -> Column:
    """Overlapping candidates for numbers from all generators."""
    wide = _let(spans(text, NUMBERS), lambda a: F.concat(a, F.flatten(F.transform(F.filter(a, lambda c: c["m"].rlike("[0-9][^0-9]")), _cut))))
    return F.concat(wide, spans(text, SHAPES))


def addresses(text: Column) -> Column:
    """Candidates for e-mail addresses."""
    return spans(text, ADDRESSES)


#: What each generator's candidates may be, their features, and a test that spares texts without any.
GENERATORS: dict[str, tuple[list[str], Callable, Callable, Callable]] = {
    "numbers": (["ip", "card", "phone"], numbers, number_features, lambda text: text.rlike("[0-9]")),
    "addresses": (["email"], addresses, address_features, lambda text: F.contains(text, F.lit("@")) | text.rlike(r"[\[({]at[\])}]|\x20at\x20[A-Za-z0-9-]+(?:\.|\x20?[\[({]dot|\x20dot\x20)[A-Za-z]")),
}


def disguises(kind: str, m: Column) -> list[tuple[str, Column, str]]:
    """Forms of a base span that no base pattern takes: (what is put before, the form,
    what is put after)."""
    d = _digits(m)
    if kind == "phone":
        last = lambda *signs: F.concat(F.lit(signs[0]), F.substring(F.right(d, F.lit(10)), 1, 3), F.lit(signs[1]), F.substring(F.right(d, F.lit(10)), 4, 3), F.lit(signs[2]), F.right(d, F.lit(4)))
        return [("", F.ltrim(F.replace(m, F.lit("+"), F.lit(""))), ""), ("", F.concat(F.lit("00"), F.replace(m, F.lit("+"), F.lit(""))), ""), ("", last("", "-", "-"), ""), ("", last("(", ") ", "-"), ""), ("", last("", ".", "."), ""), ("", last("", " ", " "), "")]
    if kind == "card":
        groups = lambda sign: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{sign}")
        return [("", groups("."), ""), ("", groups("  "), ""), ("", groups("--"), ""), ("20 ", d, ""), ("", d, " 7"), ("1000 ", groups(" "), "")]
    if kind == "ip":
        return [("", F.replace(m, F.lit("."), F.lit(x)), "") for x in (" . ", ". ", "[.]", "(.)", "-")]
    at, dot = (lambda x: F.replace(m, F.lit("@"), F.lit(x))), lambda c, x: F.regexp_replace(c, r"\.(?=[A-Za-z0-9-]+$)", x)
    return [("", at(" [at] "), ""), ("", dot(at(" [at] "), " [dot] "), ""), ("", dot(at(" at "), " dot "), ""), ("", at("(at)"), ""), ("", at(" @ "), ""), ("", dot(at("{at}"), "{dot}"), "")]


def decoys(generator: str, r: Column, before: Column) -> list[Column]:
    """Forms of other sorts than personal data, from digits r: serial numbers, dates, amounts, versions, failed checks; pages and places."""
    cut = lambda at, n: F.substring(r, at, n)
    if generator == "numbers":
        odd = F.when(F.call_function("luhn_check", cut(1, 16)), F.concat(cut(1, 15), ((cut(16, 1).cast("int") + 1) % 10).cast("string"))).otherwise(cut(1, 16))
        return [
            cut(1, 9), cut(1, 10), cut(1, 12), F.concat(F.lit("20"), cut(1, 2), F.lit("-0"), cut(3, 1), F.lit("-1"), cut(4, 1), F.lit(" 1"), cut(5, 1), F.lit(" "), cut(6, 2)), F.concat(F.lit("978-"), cut(1, 1), F.lit("-"), cut(2, 2), F.lit("-"), cut(4, 6), F.lit("-"), cut(10, 1)),
            F.concat(cut(1, 1), F.lit(" "), cut(2, 3), F.lit(" "), cut(5, 3), F.lit(" "), cut(8, 3)), F.concat(cut(1, 2), F.lit("."), cut(3, 9)), F.concat(F.lit("3"), cut(1, 2), F.lit("."), cut(3, 2), F.lit("."), cut(5, 2), F.lit("."), F.lit("7"), cut(7, 2)),
            odd, F.regexp_replace(odd, "([0-9]{4})(?=[0-9])", "$1 "), F.concat(F.lit("00"), cut(1, 3), F.lit("-"), cut(4, 3), F.lit("-"), cut(7, 5)), cut(1, 14),
        ]
    word = F.coalesce(F.nullif(F.regexp_extract(before, "([A-Za-z]{2,})[^A-Za-z]*$", 1), F.lit("")), F.lit("note"))
    return [F.concat(word, F.lit(" at www."), word, F.lit(".com")), F.concat(word, F.lit(" at "), word, F.lit("."), word), F.concat(F.lit("v"), cut(1, 1), F.lit("@"), cut(2, 2), F.lit("."), cut(4, 2)), F.concat(cut(1, 2), F.lit(" @ "), cut(3, 2), F.lit("."), cut(5, 2))]


@dataclass
class PiiModel:
    """Per kind its trees, the logit from which on a candidate is added, and what that
    gives on the held-back examples: (precision, recall, number of spans)."""

    trees: dict[str, boosting.Boosted]
    cut: dict[str, float]
    held: dict[str, tuple[float, float, int]]


def _seen(generator: str, text: Column) -> Column:
    """Candidates (s, e, m, f) with their features, which stand in a transform, as a
    column of their own would make too much code for one stage."""
    _, find, features, _ = GENERATORS[generator]
    return F.transform(find(text), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), features(c).alias("f")))


def examples(docs: DataFrame, text_col: str = "text", most_docs: int = 20_000) -> DataFrame:
    """(h, generator, own, f, kind): candidates with their features and the kind that they
    are an example of (null: none, or not known where `own` says that a candidate stands in the
    documents as they are), from about `most_docs` documents, which a hash of
    their text chooses. h is a hash of the place that a candidate comes from."""
    t = fresh(docs.columns)
    share = min(1.0, most_docs / max(1, docs.count()))
    some = docs.select(F.col(text_col)).where(F.pmod(F.xxhash64(text_col), F.lit(1 << 40)) <= int(share * (1 << 40)))
    based = with_base(written(some, "pii_sample"), text_col, t)
    named = lambda k: lambda c: F.struct(F.lit(k).alias("kind"), c["m"].alias("m"), c["b"].alias("b"), c["a"].alias("a"))
    spans_of = [F.transform(f"{t}base_{k}", named(k)) for k in KINDS]
    parts = []
    own = written(based.select(F.xxhash64(f"{t}text").alias("h"), F.concat(*spans_of).alias("base"), *[F.when(may(F.col(f"{t}rest")), _seen(g, F.col(f"{t}rest"))).alias(g) for g, (*_, may) in GENERATORS.items()]), "pii_spans")
    base = own.select("h", F.explode("base").alias("x")).select(F.xxhash64("h", "x.m", "x.b").alias("h"), "x.*")
    for g, (kinds, *_) in GENERATORS.items():
        parts.append(own.select("h", F.explode(g).alias("c")).select(F.xxhash64("h", "c.m", "c.s").alias("h"), F.lit(g).alias("generator"), F.lit(True).alias("own"), "c.f", F.lit(None).cast("string").alias("kind")))
        hidden = [F.when(F.col("kind") == k, F.array(*[F.struct(F.lit(x).alias("x"), form.alias("form"), F.lit(y).alias("y")) for x, form, y in disguises(k, F.col("m"))])) for k in kinds]
        hidden = base.where(F.col("kind").isin(kinds)).select("h", "kind", "b", "a", F.explode(F.coalesce(*hidden)).alias("d"))
        turn = lambda k: F.get("others", F.pmod(F.shiftright("h", 8 * k), F.size("others")).cast("int"))
        wrong = base.withColumn("r", F.regexp_replace(F.sha2(F.col("h").cast("string"), 512), "[^0-9]", "")).withColumn("others", F.array(*decoys(g, F.col("r"), F.col("b"))))
        wrong = wrong.select("h", F.lit(None).cast("string").alias("kind"), "b", "a", F.explode(F.array(*[F.struct(F.lit("").alias("x"), turn(k).alias("form"), F.lit("").alias("y")) for k in range(4)])).alias("d"))
        placed = hidden.unionByName(wrong).select("h", "kind", F.concat("b", "d.x", "d.form", "d.y", "a").alias("text"), *[F.char_length(c).alias(c.removeprefix("d.")) for c in ("b", "d.x", "d.form", "d.y")])
        # what stands in the context only, may be personal data of another place
        shown = placed.withColumn("c", F.explode(_seen(g, F.col("text")))).where((F.col("c.e") > F.col("b")) & (F.col("c.s") < F.col("b") + F.col("x") + F.col("form") + F.col("y")))
        meets = (F.col("c.s") == F.col("b") + F.col("x")) & (F.col("c.e") == F.col("c.s") + F.col("form"))
        parts.append(shown.select("h", F.lit(g).alias("generator"), F.lit(False).alias("own"), "c.f", F.when(meets, F.col("kind")).alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out, "pii_examples")


#: The share of disguised spans that the first trees may rank below an unlabelled candidate for it to count as none.
UNLIKELY = 0.02


def fit(docs: DataFrame, text_col: str = "text", most_rows: int = 8000, precision: float = 0.95, most_docs: int = 20_000) -> PiiModel:
    """Fits the trees to at most `most_rows` labelled and as many unlabelled examples of each
    generator, those with the smallest hash, from about `most_docs` documents; the
    examples of every third place are held back to set the thresholds.

    However much personal data of a form that the base patterns miss a corpus holds, it
    isn't learned as none: see UNLIKELY. With more documents the share taken falls, so what reaches the driver doesn't grow.
    A table without base spans teaches nothing, and nothing is added to its texts.
    """
    found, model = examples(docs, text_col, most_docs), PiiModel({}, {}, {})
    for g, (kinds, *_) in GENERATORS.items():
        some = lambda own: found.where((F.col("generator") == g) & (F.col("own") == own)).orderBy(F.xxhash64("h"), "h", "f", "kind").limit(most_rows).collect()
        rows, own = some(False), some(True)
        x = np.array([r["f"] for r in rows], dtype=float)
        back = np.array([r["h"] % 3 == 0 for r in rows], dtype=bool)
        own_x, own_back = np.array([r["f"] for r in own], dtype=float), np.array([r["h"] % 3 == 0 for r in own], dtype=bool)
        for kind in kinds:
            y = np.array([r["kind"] == kind for r in rows], dtype=float)
            if not y[~back].any() or not y[back].any():
                model.trees[kind], model.cut[kind], model.held[kind] = boosting.Boosted(np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)), 0.0), float("inf"), (1.0, 0.0, int(y.sum()))
                continue
            trees, all_x, all_y, all_back = boosting.fit(x[~back], y[~back], trees=24, depth=3), x, y, back
            if len(own):
                none = trees.logits(own_x) < np.quantile(trees.logits(x[~back & (y > 0)]), UNLIKELY)
                all_x, all_y, all_back = np.concatenate([x, own_x[none]]), np.concatenate([y, np.zeros(none.sum())]), np.concatenate([back, own_back[none]])
                trees = boosting.fit(all_x[~all_back], all_y[~all_back], trees=24, depth=3)
            logits, held = trees.logits(all_x[all_back]), all_y[all_back]
            cut = boosting.threshold(logits, held, precision)
            taken = logits >= cut
            model.trees[kind], model.cut[kind] = trees, cut
            model.held[kind] = (float(held[taken].mean()) if taken.any() else 1.0, float(taken[held > 0].mean()), int(held.sum()))
    return model


def _beyond(model: PiiModel, kinds: list[str], features: Callable) -> Callable[[Column], Column]:
    """A candidate's place, and how far the best kind's logit is beyond its threshold."""
    width = max(int(model.trees[k].feature.max(initial=0)) for k in kinds) + 1

    def judge(c: Column) -> Column:
        def over(f: Column) -> Column:
            values = [F.get(f, F.lit(i)) for i in range(width)]
            each = [F.struct((model.trees[k].column(values) - F.lit(model.cut[k])).alias("over"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind")) for k in kinds]
            return F.array_max(F.array(*each))

        return F.struct(c["s"].alias("start"), c["e"].alias("end"), c["a"].rlike("^[0-9]").alias("ragged"), _let(features(c), over).alias("o"))

    return judge


def _apart(added: Column) -> Column:
    """Goes through the candidates in order of start and keeps, of one that overlaps the
    last kept, the better: that which cuts no number, then that furthest beyond its
    threshold, then the longer."""
    rank = lambda c: F.struct(~c["ragged"], c["o"]["over"], c["end"] - c["start"])

    def step(acc: Column, c: Column) -> Column:
        last = acc["last"]
        return (
            F.when(last.isNull(), F.struct(acc["out"].alias("out"), c.alias("last")))
            .when(c["start"] >= last["end"], F.struct(F.array_append(acc["out"], last).alias("out"), c.alias("last")))
            .when(rank(c) > rank(last), F.struct(acc["out"].alias("out"), c.alias("last")))
            .otherwise(acc)
        )

    start = F.struct(F.filter(added, lambda c: F.lit(False)).alias("out"), F.get(F.filter(added, lambda c: F.lit(False)), F.lit(0)).alias("last"))
    scan = lambda a: F.aggregate(F.array_sort(a), start, step, lambda acc: F.array_append(acc["out"], acc["last"]))
    return F.when(F.size(added) < 2, added).otherwise(scan(added))


def _clear(added: Column, base: Column) -> Column:
    """Without candidates that overlap a base span. The covering leaves hardly any, so
    their places are met in one go first."""
    places = lambda a, s, e: F.flatten(F.transform(a, lambda c: F.sequence(c[s], c[e] - 1)))
    free = lambda c: ~F.exists(base, lambda b: (b["s"] < c["end"]) & (c["start"] < b["e"]))
    return F.when((F.size(added) == 0) | ~F.arrays_overlap(places(added, "start", "end"), places(base, "s", "e")), added).otherwise(F.filter(added, free))


def find_pii(docs: DataFrame, model: PiiModel | None = None, text_col: str = "text") -> DataFrame:
    """Adds pii (array of (start, rank, end, kind, base), in order of start, then of kind
    as in KINDS) to docs, in place of a column of that name. Positions are code
    points, the end exclusive.

    Defined cases: null is an empty text and has no span; texts are searched whole;
    base spans of different kinds may overlap, added ones overlap none; of candidates
    for several kinds the kind furthest beyond its threshold is taken; rows are judged by
    their own text, so repeated rows agree; extra columns of any name pass through; an
    empty table stays empty.
    """
    kept, t = [c for c in docs.columns if c != "pii"], fresh(docs.columns)
    model = model or fit(docs, text_col)
    out = with_base(docs.select(*[F.col(f"`{c}`") for c in kept]), text_col, t)

    def listed(kind: str) -> Callable[[Column], Column]:
        return lambda c: F.struct(c["s"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), c["e"].alias("end"), F.lit(kind).alias("kind"), F.lit(True).alias("base"))

    parts = [F.transform(f"{t}base_{k}", listed(k)) for k in KINDS]
    every = F.concat(*[F.col(f"{t}base_{k}") for k in KINDS])
    for g, (kinds, find, features, may) in GENERATORS.items():
        use = [k for k in kinds if np.isfinite(model.cut[k])]
        if not use:
            continue
        judged = F.filter(F.transform(find(F.col(f"{t}rest")), _beyond(model, use, features)), lambda c: c["o"]["over"] >= 0)
        out = out.withColumn(f"{t}{g}", F.when(may(F.col(f"{t}rest")), judged))
        out = out.withColumn(f"{t}{g}", F.when(F.size(f"{t}{g}") > 0, _let(_apart(F.col(f"{t}{g}")), lambda a: _clear(a, every))))
        added = F.transform(f"{t}{g}", lambda c: F.struct(c["start"].alias("start"), c["o"]["rank"].alias("rank"), c["end"].alias("end"), c["o"]["kind"].alias("kind"), F.lit(False).alias("base")))
        parts.append(F.coalesce(added, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>")))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat(*parts)).alias("pii"))


def redact(docs: DataFrame, model: PiiModel | None = None, text_col: str = "text") -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets; of
    overlapping spans the first is replaced, and the rest of a later one cut off. A
    column named pii isn't passed on."""
    found = find_pii(docs, model, text_col).withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    step = lambda acc, p: F.when(p["end"] <= acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.greatest(p["start"] - acc["at"], F.lit(0))), F.lit("["), p["kind"], F.lit("]")).alias("out"), p["end"].alias("at")))
    done = F.aggregate("pii", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.char_length(F.col(text_col)))))
    return found.withColumn(text_col, done).drop("pii")
