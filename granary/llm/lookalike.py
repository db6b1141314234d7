"""One consistent form for text that looks the same but differs in its characters (problem 2).

Counts over all texts come first: of code points, of letters with marks, and of
pairs of neighbouring letters. A union-find joins strings that look the same:
full-width, styled and ligature forms with plain ones, letter plus mark with the
accented letter, invisible characters with nothing, spaces with the space, letters
of other scripts with the Latin ones of the same skeleton in the public table of
confusable characters; so the classes are transitive. The most frequent plain
member stands for its class. Where a class has several, as I and l for a stroke of
another script, the pairs of letters around the place choose; and where a mixed word
can be read wholly in either script, the reading whose pairs are more frequent is
taken, so that a Latin letter in a Cyrillic word doesn't turn the word into Latin.
An automaton over all members rewrites each text from left to right, longest match
first. The tables are bounded by Unicode, not by the data.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("аеосрхуіѕјһԁԛԝԍᴦАВЕКМНОРСТХУІЅЈԚԜЗвкмтнг", "aeocpxyisjhdqwgrABEKMHOPCTXYISJQW3bkmthr"))
GREEK = dict(zip("οονιαρυκτγχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oovıaρuktyxwABEZHIKMNOPTYX"))
OTHERS = dict(zip("օսհոցԼІӏᎪᎬᎷᏢᏚ", "ouhngLIlAEMPS"))
# The small forms of в, к, м, т, н, г and of ι, ρ, κ, τ, γ, χ, ω differ visibly, but stand for Latin letters in mixed words.
LETTERS = {**CYRILLIC, **OTHERS, **GREEK, "ρ": "p", "ι": "i"}
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad\u180e\u202a\u202b\u202c\u202d\u202e\u034f"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Deviations, in the order in which they are reported.
DEVIATIONS = ("width", "combining", "invisible", "space", "lookalike")
CACHE, LONGEST = 200_000, 200
#: Code points below are counted in pairs: Latin, Greek, Cyrillic and Armenian letters.
PAIRED = 0x600

MARK = "\u0300-\u036f"
SEQUENCE = re.compile(rf"[^\W\d_][{MARK}]+")
ODD_TOKEN = re.compile(r"\S+")
ODD_SPACE = re.compile(f"[{SPACES}]")
WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{MARK}{INVISIBLE}'’])*")


def is_latin(c: str) -> bool:
    return c.isalpha() and (c.isascii() or unicodedata.name(c, "").startswith("LATIN"))


def joins(c: str) -> bool:
    """A character of a script with joiners of its own (Devanagari to Malayalam and Sinhala, Arabic, ...)."""
    return "֐" <= c <= "ࣿ" or "ऀ" <= c <= "࿿" or "က" <= c <= "႟" or "ក" <= c <= "᢯" or ord(c) >= 0x1F000


def plain_form(s: str) -> tuple[str, str] | None:
    """(deviation, plain form) of one code point or letter with marks; None where it has no other form."""
    if s in INVISIBLE:
        return "invisible", ""
    if s in SPACES:
        return "space", " "
    if len(s) > 1:
        one = unicodedata.normalize("NFC", s)
        return ("combining", one) if len(one) < len(s) and is_latin(s[0]) else None
    kind = unicodedata.decomposition(s).split(" ")[0]
    if kind in ("<wide>", "<font>", "<small>", "<narrow>") or "ﬀ" <= s <= "ﬆ":
        to = unicodedata.normalize("NFKC", s)
        return ("width", to) if to.isascii() else None
    return ("lookalike", LETTERS[s]) if s in LETTERS else None


@lru_cache(maxsize=1)
def variants() -> dict[str, tuple[str, str]]:
    """Every code point that has a plain form, and every way of taking an accented Latin letter apart: a rule over Unicode, not a list."""
    points = [chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    out = {c: v for c in points if (v := plain_form(c))}
    for c in points:
        if ord(c) < 0x2100 and is_latin(c) and len(apart := unicodedata.normalize("NFD", c)) > 1:
            for marks in permutations(apart[1:]):
                for i in range(len(marks)):
                    s = unicodedata.normalize("NFC", apart[0] + "".join(marks[:i])) + "".join(marks[i:])
                    if len(s) > 1 and unicodedata.normalize("NFC", s) == c and (v := plain_form(s)):
                        out[s] = v
    return out


def confusables(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    """Letters of other scripts with the Latin letters of the same skeleton, from the table of confusable characters that the JVM has. Fails without one: texts rewritten without the table would look like any others."""
    latin = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]
    others = [c for c in map(chr, range(0x370, 0x1E000)) if c.isalpha() and not is_latin(c) and not joins(c) and not "\u2e80" <= c <= "\ud7ff" and (plain_form(c) or ("lookalike",))[0] == "lookalike"]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join(latin + others)).split("\n")
    except Exception as e:
        raise RuntimeError("the table of confusable characters can't be read; it comes with ICU4J (com.ibm.icu.text.SpoofChecker), which must be among the driver's jars") from e
    if len(skeletons) != len(latin) + len(others):
        raise RuntimeError(f"the table of confusable characters gives {len(skeletons)} skeletons for {len(latin) + len(others)} letters")
    same: dict[str, list[str]] = {}
    for c, k in zip(latin, skeletons):
        same.setdefault(k, []).append(c)
    return {c: tuple(same[k]) for c, k in zip(others, skeletons[len(latin) :]) if k in same}


def letter_options(more: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """Letters of other scripts with the Latin ones that they may stand for, those of the fixed list first."""
    out = {c: (to,) for c, to in LETTERS.items()}
    for c, found in (more or {}).items():
        out[c] = tuple(dict.fromkeys((*out.get(c, ()), *found)))
    return out


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (p := self.parent.setdefault(root, root)) != root:
            root = p
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def profile(df: DataFrame, text: str) -> DataFrame:
    """(form, n): how often each code point, each letter with marks and each pair of neighbouring letters (a blank is none) occurs in all texts. Summed before the shuffle.

    Pairs have a line break before them. All three are bounded by Unicode.
    """
    paired = np.array([i if chr(i).isalpha() else 32 for i in range(PAIRED)] + [32], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sequences, pairs = np.zeros(sys.maxunicode + 1, dtype=np.int64), Counter(), np.zeros(PAIRED * PAIRED, dtype=np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            whole = "\n".join(texts)
            if not whole:
                continue
            if whole.isascii():
                codes = np.frombuffer(whole.encode("ascii"), dtype=np.uint8)
            else:
                codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                sequences.update(s for t in texts if not t.isascii() for s in SEQUENCE.findall(t))
            found = np.bincount(codes)
            points[: len(found)] += found
            letters = paired[np.minimum(codes.astype(np.uint32), PAIRED)]
            found = np.bincount(letters[:-1] * PAIRED + letters[1:])
            pairs[: len(found)] += found
        at = np.flatnonzero(points)
        at = at[(at < 0xD800) | (at > 0xDFFF)]
        kept = [(s, n) for s, n in sequences.items() if s in variants()]  # finitely many
        two = np.flatnonzero(pairs)
        forms = [chr(c) for c in at] + [s for s, _ in kept] + [f"\n{chr(p // PAIRED)}{chr(p % PAIRED)}" for p in two]
        yield pa.RecordBatch.from_pydict({"form": forms, "n": [int(n) for n in points[at]] + [n for _, n in kept] + [int(n) for n in pairs[two]]}, schema=pa.schema([("form", pa.string()), ("n", pa.int64())]))

    return df.select(text).mapInArrow(run, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))


def classes(counts: dict[str, int], options: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Member to representative: the most frequent member that is no deviation itself. A form of one certain letter keeps to it, even in a class of several."""
    options = options or letter_options()
    sets, known = UnionFind(), dict(variants())
    for s, (_, to) in known.items():
        sets.union(s, to)
    for c, latin in options.items():
        for to in latin:
            sets.union(c, to)
    out = {}
    for members in sets.classes():
        plain = [m for m in members if m not in known and m not in options] or members
        order = {m: (-counts.get(m, 0), len(m), m) for m in members}
        for m in members:
            own = options.get(m) or (known[m][1],) if m in known or m in options else (m,)
            best = min((x for x in own if x in plain), key=order.get, default=min(plain, key=order.get))
            if m != best and (m in known or m in options):
                out[m] = best
    return out


class Rewriter:
    """Greedy rewriting with an automaton over all members of all classes; text of other scripts stays as it is."""

    def __init__(self, to: dict[str, str], options: dict[str, tuple[str, ...]] | None = None, pairs: dict[str, int] | None = None):
        self.to, self.options, self.pairs = to, options or letter_options(), pairs or {}
        self.kinds = {m: v[0] for m in to if (v := plain_form(m))}
        self.kinds.update((m, "lookalike") for m in to if m in self.options)
        self.scripts: dict[str, dict[str, str]] = {}  # of each other script, the letter that looks like a Latin one
        for c, latin in self.options.items():
            for x in latin:
                self.scripts.setdefault(unicodedata.name(c, "").split(" ")[0], {}).setdefault(x, c)
        self.automaton = ahocorasick.Automaton()
        for m in to:
            self.automaton.add_word(m, m)
        self.automaton.make_automaton()
        self.seen: dict[str, tuple[str, frozenset[str]]] = {}

    def likely(self, letters: list[str]) -> float:
        """How frequent the pairs of neighbouring letters of a word are."""
        word = [" ", *letters, " "]
        return sum(np.log1p(self.pairs.get(a + b, 0)) for a, b in zip(word, word[1:]))

    def latin(self, word: list[str]) -> list[str]:
        """The word with its letters of other scripts as Latin ones; of several the one whose pairs with its neighbours are most frequent."""
        out = [self.to.get(c, c) if c in self.options else c for c in word]
        for i, c in enumerate(word):
            if len(several := self.options.get(c, ())) > 1:
                before, after = out[i - 1] if i else " ", out[i + 1] if i + 1 < len(out) else " "
                out[i] = max(several, key=lambda x: (np.log1p(self.pairs.get(before + x, 0)) + np.log1p(self.pairs.get(x + after, 0)), x == out[i]))
        return out

    def reading(self, word: list[str]) -> list[str] | None:
        """A mixed word as a word of the other script, if it can be one and its pairs are more frequent so than in Latin."""
        best, most = None, self.likely(self.latin(word))
        for script in {unicodedata.name(c, "").split(" ")[0] for c in word if c in self.options}:
            own = [c if not is_latin(c) else self.scripts[script].get(c) for c in word]
            if None not in own and (value := self.likely(own)) > most:
                best, most = own, value
        return best

    def matches(self, token: str) -> list[tuple[int, str]]:
        """Leftmost longest matches that don't overlap."""
        found: dict[int, str] = {}
        for end, m in self.automaton.iter(token):
            at = end - len(m) + 1
            if len(m) > len(found.get(at, "")):
                found[at] = m
        out, free = [], 0
        for at in sorted(found):
            if at >= free:
                out.append((at, found[at]))
                free = at + len(found[at])
        return out

    def token(self, token: str) -> tuple[str, frozenset[str]]:
        known = self.seen.get(token)
        if known is not None:
            return known
        mixed: dict[int, str] = {}
        foreign: dict[int, str] = {}
        for w in WORD.finditer(token):
            at = [i for i in range(w.start(), w.end()) if token[i].isalpha()]
            letters = [token[i] for i in at]
            own = [is_latin(c) or self.kinds.get(c) == "width" for c in letters]
            if any(own) and not all(own) and all(c in self.options for c, o in zip(letters, own) if not o):
                plain = [self.to.get(c, c) if o and len(self.to.get(c, c)) == 1 else c for c, o in zip(letters, own)]
                if (other := self.reading(plain)) is not None:
                    foreign.update((i, c) for i, c, was in zip(at, other, letters) if c != was)
                else:
                    mixed.update(zip(at, self.latin(plain)))
        if foreign:
            made, kinds = self.token("".join(foreign.get(i, c) for i, c in enumerate(token)))
            return self.kept(token, made, kinds | {"foreign"})
        has_latin = any(is_latin(c) or self.kinds.get(c) == "width" for c in token)
        before, after = self.visible(token), self.visible(token[::-1])[::-1]
        parts, done, kinds = [], 0, set()
        for at, m in self.matches(token):
            kind = self.kinds[m]
            if kind == "lookalike" and at not in mixed:
                continue
            if kind == "invisible":
                if not has_latin or any(c and joins(c) for c in (before[at], after[at])):
                    continue
            kinds.add(kind)
            parts += [token[done:at], mixed[at] if kind == "lookalike" else self.to[m]]
            done = at + len(m)
        made = "".join(parts) + token[done:]
        if made != token:  # what now stands side by side may be a member of a class again
            made, more = self.token(made)
            kinds |= more
        return self.kept(token, made, kinds)

    def kept(self, token: str, made: str, kinds: set[str]) -> tuple[str, frozenset[str]]:
        out = made, frozenset(kinds)
        if len(token) <= LONGEST:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[token] = out
        return out

    @staticmethod
    def visible(token: str) -> list[str]:
        """For each place the last visible character before it."""
        out, last = [], ""
        for c in token:
            out.append(last)
            last = last if c in INVISIBLE else c
        return out

    def text(self, text: str | None) -> tuple[str | None, list[str]]:
        """(consistent form, deviations found)."""
        if not text or text.isascii():
            return text, []
        kinds: set[str] = set()
        if ODD_SPACE.search(text):
            kinds.add("space")
            text = ODD_SPACE.sub(" ", text)

        def token(m: re.Match) -> str:
            to, found = self.token(m.group())
            kinds.update(found)
            return to

        parts = [p if p.isascii() else ODD_TOKEN.sub(token, p) for p in text.split(" ")]
        return " ".join(parts), [k for k in (*DEVIATIONS, "foreign") if k in kinds]


def rewriting(df: DataFrame, text: str) -> tuple[dict[str, str], dict[str, tuple[str, ...]], dict[str, int]]:
    """What a Rewriter of df's texts needs: representatives, letters of other scripts, counts of pairs. What comes to the driver is a count for each form in use, bounded by Unicode."""
    counts = {r.form: r.n for r in profile(df, text).collect()}
    options = letter_options(confusables(df.sparkSession))
    points = {s: n for s, n in counts.items() if len(s) < 3 or s[0] != "\n"}
    return classes(points, options), options, {s[1:]: n for s, n in counts.items() if len(s) == 3 and s[0] == "\n"}


def consistent_form(df: DataFrame, text: str = "page_content", key: str = "chunk_id") -> DataFrame:
    """key, text in its consistent form, and the deviations found, for each row of df.

    Beside DEVIATIONS stands `foreign` for Latin letters in a word of another script.
    Null stays null and empty stays empty, both without deviations. Other columns
    of df are ignored, whatever their names. Rows that occur twice come out twice.
    """
    needs = rewriting(df, text)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(text, T.StringType()), T.StructField("deviations", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(*needs)
        for b in batches:
            rows = [rewriter.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
