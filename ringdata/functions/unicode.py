"""Unicode NFKC and case folding as Column expressions, from tables that Python's unicodedata gives."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
HANGUL = range(0xAC00, 0xD7A4)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once per row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def char_class(chars) -> str:
    """The inside of a regular expression's class of these characters."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def any_of(chars) -> str:
    """A class of many characters as a regular expression. Java tries the runs of a class one after another, so they go into spans of 32 that are tried as wholes first, and ASCII passes none."""
    points = sorted(set(map(ord, chars)))
    runs = [k for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    spans = [points[a:b] for a, b in zip(runs[::32], [*runs[32::32], len(points)], strict=True)]
    inside = "".join(f"[\\x{{{x[0]:X}}}-\\x{{{x[-1]:X}}}&&[{char_class(map(chr, x))}]]" for x in spans)
    return f"[\\x{{{points[0]:X}}}-\\x{{{points[-1]:X}}}&&[{inside}]]"


#: Texts without such a character need no table.
BEYOND_ASCII = r"[^\x00-\x7F]"


def chars_of(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))


def expand(t: Column, table: dict[str, str]) -> Column:
    """t with each character replaced by its text in the table, which no other entry replaces further."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    longer = sorted((k for k in table if k not in single), key=lambda k: -len(table[k]))
    t = F.translate(t, "".join(single), "".join(single.values())) if single else t
    keys = "".join(longer)
    # one translation for each place: characters whose text ends before it come last, and go
    places = ["".join(table[k][i] for k in longer if len(table[k]) > i) for i in range(max(map(len, table.values())))]
    known = any_of(longer)
    one = lambda c: F.when(c.rlike(known), F.concat(*[F.translate(c, keys, p) for p in places])).otherwise(c)
    return F.when(t.rlike(known), F.array_join(F.transform(chars_of(t), one), "")).otherwise(t)


@cache
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, list[str]], str]:
    """Full decompositions (syllables of Hangul stay whole), combining classes as characters, pairs that compose by their second character, and the expression for all that NFKC may change."""
    split = {c: d for c in POINTS if ord(c) not in HANGUL and (d := unicodedata.normalize("NFKD", c)) != c}
    marks = {c: chr(k) for c in POINTS if (k := unicodedata.combining(c))}
    pairs: dict[str, list[str]] = {}
    for c in POINTS:
        parts = unicodedata.decomposition(c).split()
        if ord(c) in HANGUL:
            d = unicodedata.normalize("NFD", c)
            parts = [unicodedata.normalize("NFC", d[:-1]), d[-1]]
        elif len(parts) == 2 and parts[0][0] != "<":
            parts = [chr(int(p, 16)) for p in parts]
        else:
            continue
        if unicodedata.normalize("NFC", "".join(parts)) == c:
            of = pairs.setdefault(parts[1], ["", ""])
            of[0] += parts[0]
            of[1] += c
    changed = {c for c in POINTS if unicodedata.normalize("NFKC", c) != c}
    return split, marks, pairs, any_of(changed | set(marks) | set(pairs))


def nfkc(t: Column) -> Column:
    """Normalization form KC of a text: decomposed by table, marks in canonical order, composed again. Texts of ASCII, and such that hold nothing to change, cost one search."""
    split, marks, pairs, suspects = tables()
    rank = lambda c: F.translate(c, "".join(marks), "".join(marks.values()))
    mark = f"[{char_class(marks)}]"

    def ordered(run: Column) -> Column:
        keyed = F.transform(chars_of(run), lambda c, i: F.struct(rank(c).alias("k"), i.alias("i"), c.alias("c")))
        return F.when(run.rlike(f"^{mark}{{2}}"), F.array_join(F.transform(F.sort_array(keyed), lambda x: x["c"]), "")).otherwise(run)

    by_second = F.from_json(F.lit(json.dumps(pairs)), "map<string,array<string>>")

    def state(done, starter, tail, last):
        return F.struct(done.alias("done"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))

    none = F.lit("")
    swap = lambda *of: F.call_function("translate", *of)

    def add(s: Column, c: Column) -> Column:
        """One more character: composed with the starter, a new starter, or one more mark after it."""
        of = F.try_element_at(by_second, c)
        k = F.when(c.rlike(mark), rank(c)).otherwise("")
        joins = of.isNotNull() & (s["starter"] != "") & (swap(s["starter"], F.get(of, F.lit(0)), none) == "") & ((s["tail"] == "") | (s["last"] < k))
        return (
            F.when(F.coalesce(joins, F.lit(False)), state(s["done"], swap(s["starter"], F.get(of, F.lit(0)), F.get(of, F.lit(1))), s["tail"], s["last"]))
            .when(k == "", state(F.concat(s["done"], s["starter"], s["tail"]), c, none, none))
            .otherwise(state(s["done"], s["starter"], F.concat(s["tail"], c), k))
        )

    def compose(segment: Column) -> Column:
        whole = F.aggregate(chars_of(segment), state(none, none, none, none), add, lambda s: F.concat(s["done"], s["starter"], s["tail"]))
        return F.when(F.char_length(segment) > 1, whole).otherwise(segment)

    # a segment is a character that never joins the one before it, and what may join it
    follows = char_class(set(marks) | set(pairs))
    runs = lambda d: F.array_join(F.transform(F.regexp_extract_all(d, F.lit(f"(?s){mark}+|[^{mark[1:]}+"), F.lit(0)), ordered), "")
    segments = lambda d: F.array_join(F.transform(F.regexp_extract_all(d, F.lit(f"(?s)[^{follows}][{follows}]*+|[{follows}]++"), F.lit(0)), compose), "")
    return F.when(t.rlike(BEYOND_ASCII) & t.rlike(suspects), let(expand(t, split), lambda d: let(runs(d), segments))).otherwise(t)


@cache
def folds() -> dict[str, str]:
    return {c: f for c in POINTS if (f := c.casefold()) != c}


def casefold(t: Column) -> Column:
    """Full case folding (ß to ss), as Python's casefold."""
    return F.when(t.rlike(BEYOND_ASCII), expand(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), folds())).otherwise(F.lower(t))
