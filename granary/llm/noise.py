"""Repair of text from scanned pages (problem 1).

1. Word counts over all records. Words above a fixed share of all tokens are the
   vocabulary; the share bounds its size whatever the input.
2. Skip-gram vectors of the vocabulary: context counts within a window over all
   records, then the factorisation of their shifted log ratios that skip-gram
   with negative sampling optimises. Rows of the matrix stay in the cluster; the
   driver sees a square matrix over the context words and the finished vectors.
3. A rare word is linked to a frequent neighbour by plausible glyph edits. The
   edit (both words as pen strokes, an intruding sign, a lost letter) has a weight
   that grows with the length of the word; the vectors add how close the two words
   are (or, for words too rare for a vector, how well the frequent one fits the
   words around the place). Only what reaches BAR in sum is a misreading. Of several
   frequent words the one that fits best at the place is taken, each time anew.
4. Page heads and page numbers go, words cut at line ends are joined, lines of a
   paragraph become one. Heads are known from a document's name and issuer, or
   learned: lines that stand first or last on most pages of a document.

Steps 3 and 4 are row by row against broadcast tables of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.lookalike import Rewriter, classes
from granary.llm.quality import Lines
from granary.runtime import BROADCAST_ROWS, stored

#: A word is in the vocabulary from this share of all tokens on: at most 500,000 words.
VOCABULARY_SHARE = 2e-6
LEAST_COUNT = 3
#: A frequent word must be so many times as frequent as the rare one that is linked to it.
RATIO = 20
#: Parts of words run together must be frequent words.
PART_SHARE = 2e-5
WINDOW, CONTEXTS, DIMENSIONS, NEGATIVES = 2, 512, 32, 5
#: Weight of an edit for each letter beyond so many, that of an edit no letter word can stand for, and what edit and vectors must reach in sum.
LETTER, FREE_LETTERS, SURE, BAR = 0.15, 2, 2.0, 0.2
#: The more often a rare word occurs, the more its vector says: the bar rises by DOUBT up to ENOUGH occurrences.
DOUBT, ENOUGH = 0.2, 40
#: A head is learned from a line that is first or last on so many pages, and on this share of the document's pages.
HEAD_PAGES, HEAD_SHARE, EDGE_LINES = 3, 0.5, 2
CACHE = 300_000
#: No word is longer; such tokens are addresses, codes or rows without spaces.
LONGEST = 80

# Glyphs that scanning confuses, as the strokes they are made of.
STROKES = {
    "0": "o", "°": "o", "l": "i", "1": "i", "!": "i", "|": "i", "5": "s", "$": "s", "9": "g", "6": "b", "8": "b",
    "c": "e", "é": "e", "@": "a", "+": "t", "y": "v", "n": "ri", "m": "rri", "u": "ii", "h": "ii", "d": "ei", "k": "ie", "w": "vv",
}
TO_STROKES = str.maketrans(STROKES)
INTRUDERS = "~^_|\\{}[]«»<>#*=¦§¬"
SEPARATORS = "~^_|\\{}[]«»<>#*=¦§.,;:j/"
INTRUDER = re.compile("[" + re.escape(INTRUDERS) + "]")
EDGE = ".,;:()\"'“”‘’?"
BULLET_EDGE = "°•»«*=~-+¢©>#§"
ODD_GLYPH = re.compile(r"[^\W\d_]+[0156789@+!°|$][^\W\d_]+")
DIGITS_WITH_LETTERS = re.compile(r"[₹(]?(?:[OolISBZ]+,)?[\dOolISBZ]*\d[\dOolISBZ,./]*%?")
FORM_NUMBER = re.compile(r"\d{1,4}[A-Za-z]{1,3}")
PLAIN_NUMBER = re.compile(r"[^A-Za-z]*")
CUT = re.compile(r"(?:^|[\s(“\"'‘])([^\s|\-“\"'‘(¬]+(?:-[^\s|\-¬]+)*)[-¬]\s*$")
CUT_WORDS = re.compile(r"(?<!\S)\S{1,80}[-¬][ \t]*\n\s*\S+")
FIRST = re.compile(r"\s*[(“\"'‘]*([^\s.,;:()“”\"]+)")
LETTERS = re.compile(r"[^a-z]+")
PDF = re.compile(r"\.pdf\s*$", re.I)
PAGE_LETTERS = ("", "page", "pageno", "p", "pg", "pageof", "of", "pagenumber")
HEAD_PARTS = re.compile(r"\s+[|*–—]\s+")
PAGE_SIGNS = re.compile(r"[\w\s|~\[\]()/.·*–—-]*")
#: Lines after a cut word in which its rest is sought.
AHEAD = 4
#: A line of this share of the widest one was wrapped, even if it ends a sentence.
FULL = 0.8
SECTION_LINE = ("Section:", "Subsection:")


def strokes(word: str) -> str:
    return word.translate(TO_STROKES)


def near(a: str, b: str, share: float = 0.12) -> bool:
    """Edit distance within a share of the length."""
    if a == b:
        return True
    most = int(share * max(len(a), len(b)))
    if not a or not b or abs(len(a) - len(b)) > most or most == 0:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def letters(s: str | None) -> str:
    return LETTERS.sub("", (s or "").lower())


@dataclass
class Model:
    """Vocabulary with counts, stroke index and skip-gram vectors; the links of its rare words."""

    counts: dict[str, int]
    total: int
    vectors: np.ndarray | None = None
    ids: dict[str, int] = field(default_factory=dict)
    contexts: np.ndarray | None = None
    context_ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = self.ids or {w: i for i, w in enumerate(sorted(self.counts))}
        self.by_strokes: dict[str, list[str]] = {}
        for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)):
            self.by_strokes.setdefault(strokes(w), []).append(w)
        self.part_count = max(RATIO * LEAST_COUNT, PART_SHARE * self.total)
        self.by_loss: dict[str, list[str]] = {}
        for w, n in self.counts.items():
            if len(w) >= 5 and n >= self.part_count:
                for i in range(len(w)):
                    self.by_loss.setdefault(w[:i] + w[i + 1 :], []).append(w)
        self.misread = {w: v for w in self.counts if (v := self.links(w))}
        self.known = frozenset(w for w in self.counts if w not in self.misread)

    def links(self, word: str) -> list[tuple[float, str]]:
        """(weight, frequent word) of the neighbours of a vocabulary word in glyphs and vectors, past the bar already."""
        found = self.same_strokes(word, self.counts[word])
        bar = BAR + DOUBT * min(1.0, self.counts[word] / ENOUGH)
        return [(SURE, v) for weight, v in found if weight + self.closeness(word, v) >= bar]

    def same_strokes(self, word: str, count: int) -> list[tuple[float, str]]:
        """(weight of the edit, frequent word with the same strokes)."""
        found = [v for v in self.by_strokes.get(strokes(word), ()) if v != word and self.counts[v] >= RATIO * max(count, 1)]
        return [(SURE if not word.isascii() or not word.isalpha() else LETTER * (len(word) - FREE_LETTERS), v) for v in found]

    def closeness(self, a: str, b: str) -> float:
        """Cosine of two words' vectors."""
        if self.vectors is None or a not in self.ids or b not in self.ids:
            return 0.0
        p, q = self.vectors[self.ids[a]], self.vectors[self.ids[b]]
        size = float(np.linalg.norm(p) * np.linalg.norm(q))
        return float(p @ q) / size if size else 0.0

    def chosen(self, options: list[tuple[float, str]], around: list[str]) -> str | None:
        """The best of the options (weight, word) at this place, or None if none reaches the bar."""
        fits = {v: self.fit(v, around) for _, v in options}
        past = [(fits[v] + 0.1 * np.log(self.counts[v]), v) for weight, v in options if weight + fits[v] >= BAR]
        return max(past)[1] if past else None

    def fit(self, word: str, around: list[str]) -> float:
        """How well a word's vector agrees with those of its neighbours: as contexts where they are context words, else as words."""
        if self.vectors is None or word not in self.ids:
            return 0.0
        near = [self.contexts[self.context_ids[w]] if w in self.context_ids else self.vectors[self.ids[w]] for w in around if w in self.ids]
        if not near:
            return 0.0
        v, c = self.vectors[self.ids[word]], np.sum(near, axis=0)
        size = float(np.linalg.norm(v) * np.linalg.norm(c))
        return float(v @ c) / size if size else 0.0


class Scanner:
    """Finds and repairs noise of one record after another."""

    def __init__(self, model: Model, common: frozenset[str]):
        self.m = model
        self.lines = Lines(common)
        self.rewriter = Rewriter(classes({}))
        self.seen: dict[str, str | list | None] = {}
        self.sound: set[str] = set()  # those of them that are sound anywhere

    # words

    def word(self, token: str, around: list[str], first: bool = False) -> str | None:
        """None if the token is sound at this place, else what it should be. Only what no context can change is kept by token."""
        key = "\n" + token if first else token
        if key in self.seen:
            out = self.seen[key]
        else:
            if len(self.seen) >= CACHE:
                self.seen.clear()
                self.sound.clear()
            out = self.judge(token, first)
            if isinstance(out, list) and len(out) == 1 and out[0][0] >= 1 + BAR:
                out = out[0][1]  # past the bar whatever stands around it
            self.seen[key] = out
            if out is None:
                self.sound.add(key)
        return self.m.chosen(out, around) if isinstance(out, list) else out

    def judge(self, token: str, first: bool) -> str | list[tuple[float, str]] | None:
        """None if the token is sound, else what it should be, or the frequent words that it may be with the weights of the edits."""
        m = self.m
        if len(token) > LONGEST:
            return None
        if not token.isascii():
            token = self.rewriter.token(token)[0]
        if first:
            token = token.lstrip(BULLET_EDGE)
        core = token.strip(EDGE)
        low = core.lower()
        if len(low) < 2 or (len(low) < 3 and low.isalpha()) or low in m.known or low.rstrip("!") in m.known:
            return None
        if low in m.misread:
            return m.misread[low]
        if PLAIN_NUMBER.fullmatch(core):
            return None
        if DIGITS_WITH_LETTERS.fullmatch(core) and any(c in "OolISBZ" for c in core):
            if FORM_NUMBER.fullmatch(core) and not any(c in "OolI" for c in core):
                return None
            return core.translate(str.maketrans("OolISBZ", "0011582"))
        if sum(c.isalpha() for c in low) < 2:
            return None
        if found := m.same_strokes(low, 1):
            return found
        if INTRUDER.search(low):
            bare = INTRUDER.sub("", low)
            if bare in m.known:
                return bare
            if found := m.misread.get(bare) or m.same_strokes(bare, 1):
                return [(SURE, v) for _, v in found]
        if to := self.run_together(low):
            return to
        if "-" in low or "/" in low or "'" in low or "’" in low:
            parts = [p for p in re.split(r"[-/'’]", low) if p]
            if all(p in m.known or len(p) < 2 for p in parts):
                return None
            fixed = [p if p in m.known or len(p) < 2 else m.chosen(m.misread.get(p) or m.same_strokes(p, 1), []) for p in parts]
            return "-".join(fixed) if all(fixed) else None
        if low.isascii() and low.isalpha() and len(low) >= 4 and (found := m.by_loss.get(low)):
            return [(LETTER * (len(low) - 1), v) for v in found]
        if low.isascii() and len(low) >= 5 and ODD_GLYPH.fullmatch(low) and not FORM_NUMBER.fullmatch(low):
            return low.translate(str.maketrans("01569@+!°|$", "oisggatioia"[:11]))
        if INTRUDER.search(low) and sum(c.isalpha() for c in low) >= 4 and len(INTRUDER.findall(low)) == 1 and low[0].isalpha() and low[-1].isalpha():
            return INTRUDER.sub("", low)
        return None

    def part(self, w: str) -> bool:
        return (len(w) > 1 or w == "a") and self.m.counts.get(w, 0) >= self.m.part_count and w in self.m.known

    def run_together(self, low: str) -> str | None:
        for i in range(1, len(low) - 1):
            if low[i] in SEPARATORS and self.part(low[:i]) and self.part(low[i + 1 :]):
                return f"{low[:i]} {low[i + 1 :]}"
        if len(low) >= 5 and low.isalpha():
            for i in range(1, len(low)):
                if self.part(low[:i]) and self.part(low[i:]) and (min(i, len(low) - i) > 1 or len(low) >= 6):
                    return f"{low[:i]} {low[i:]}"
        return None

    # lines

    @staticmethod
    def page_number(line: str, page: int | None) -> bool:
        """The line holds nothing but the page's number."""
        if len(line) > 24 or page is None or not any(c.isdigit() or c in "OolI" for c in line):
            return False
        numbers = re.findall(r"\d+", line.translate(str.maketrans("OolI", "0011")) if not line.lower().startswith("p") else line)
        return str(page) in numbers and PAGE_SIGNS.fullmatch(line) is not None and len(numbers) <= 2 and (letters(line) in PAGE_LETTERS or near(letters(line), "page", 0.25))

    @staticmethod
    def heads(name: str | None, issuer: str | None) -> tuple[list[str], frozenset[str]]:
        """Letters of the page heads that a document may have, and their words."""
        name = PDF.sub("", name or "").strip()
        full, base, by = letters(name), letters(name.split(" - ")[0]), letters(issuer)
        out = [full, *([by, full + by, by + full, base + by, by + base] if by else [])]
        return [h for h in out if len(h) >= 8], frozenset(f"{name} {issuer or ''} page".lower().split())

    def head(self, line: str, heads: list[str], words: frozenset[str], name: str | None = None) -> bool:
        """The line is one of the heads. name: of a document whose issuer isn't known, so that any issuer may stand beside the name."""
        if not 8 <= len(line) <= 160:
            return False
        tokens = line.lower().split() if line.isascii() else self.rewriter.text(line)[0].lower().split()
        parted = name is not None and HEAD_PARTS.search(line) is not None
        if not parted and (words.isdisjoint(tokens) and len(tokens) > 1 or 2 * sum(map(words.__contains__, tokens)) < len(tokens) - 1):
            return False
        core = letters(line if line.isascii() else self.rewriter.text(line)[0])
        core = core[:-4] if core.endswith("page") and core not in heads else core
        if any(near(core, h) for h in heads):
            return True
        parts = [letters(p) for p in HEAD_PARTS.split(line)] if parted and not line.endswith((".", ",", ";")) else []
        names = (letters(name), letters(name.split(" - ")[0])) if parts else ()
        return len(parts) == 2 and any(near(p, n) for p in parts for n in names) and all(w[:1].isupper() or w in ("of", "for", "and", "the") or not w[:1].isalpha() for w in line.split())

    def scan(self, text: str | None, name: str | None, issuer: str | None, page: int | None, chunk: bool = True, learned: list[int] | None = None, repair: bool = True) -> tuple[list[tuple[int, str]], str | None]:
        """([(line number from 1, noise)], repaired text or None) of one record."""
        if not text:
            return [], text
        rows = text.split("\n")
        noise: list[tuple[int, str]] = []
        heads, words = self.heads(name, issuer)
        plain = None if issuer else PDF.sub("", name or "").strip()
        furniture: dict[int, str] = {}
        body = [i for i, r in enumerate(rows) if r.strip() and not r.strip().startswith(SECTION_LINE)]
        titled = page == 1 and body and self.head(rows[body[0]].strip(), heads[:1], words)
        # A column of cells holds bare numbers; a page number among them stands out by a head next to it.
        for i in body:
            line = rows[i].strip()
            if self.head(line, heads, words, plain) and not (titled and i == body[0]):
                furniture[i] = "header"
            elif self.page_number(line, page):
                furniture[i] = "pageno"
        if learned:  # heads that stand on most pages of the document
            free = [i for i in body if i not in furniture]
            for i in {*free[:EDGE_LINES], *free[-EDGE_LINES:]} if len(free) > EDGE_LINES else ():
                if head_key(name, rows[i]) in learned and not (page == 1 and i == body[0]):
                    own = any(len(h) >= 8 and (h in letters(rows[i]) or letters(rows[i]) in h) for h in heads)
                    furniture[i] = "header" if own else "repeated"
        bare = [i for i, k in furniture.items() if k == "pageno" and rows[i].strip().isdigit()]
        kind = None
        if bare and sum(rows[i].strip().isdigit() for i in body) > 3:
            kind = self.lines.kind(text, name)[0]
            for i in bare:
                beside = {furniture.get(j) for j in (i - 1, i + 1)}
                alone = (i == 0 or not rows[i - 1].strip()) and i == body[0]
                if kind in ("table", "junk") and "header" not in beside and not alone:
                    del furniture[i]
        noise += [(i + 1, k) for i, k in furniture.items()]
        flow = [i for i in body if i not in furniture]
        joined: dict[int, tuple[str, str]] = {}
        fixes: dict[int, list[tuple[str, str]]] = {}
        heads_of_cut: set[int] = set()
        cut_lines: set[int] = set()
        for a, i in enumerate(flow[:-1]):
            cut = CUT.search(rows[i].split()[-1]) if rows[i].rstrip()[-1:] in ("-", "¬") else None
            if not cut or not any(c.isalpha() for c in cut.group(1)):
                continue
            left = self.fold(cut.group(1))
            rest = self.rest_of(left, [rows[j] for j in flow[a + 1 : a + 1 + AHEAD]])
            if rest is None:
                continue
            away, raw = rest
            right, onto = self.fold(raw), flow[a + 1 + away]
            whole, c = left + right, self.m.counts
            split = c.get(f"{left}-{right}".lower(), 0) <= c.get(whole.lower(), 0)
            cut_lines.add(i)
            heads_of_cut.add(onto)
            if split:
                noise.append((i + 1, "hyphen"))
            if away == 0 and rows[onto].lstrip("\t (“\"'‘").startswith(raw):
                joined[i] = (cut.group(1), "" if split else "-")
            if split and (to := self.word(whole, [])):
                if to.startswith(left.lower()):
                    fixes.setdefault(onto, []).append((raw, to[len(left) :]))
                else:
                    fixes.setdefault(i, []).append((cut.group(1), to[: -len(right)] if to.endswith(right.lower()) else left))
        for i in flow:
            tokens = rows[i].split()
            if "\n" + tokens[0] in self.sound and self.sound.issuperset(tokens[1:]):
                continue
            sound, found = self.sound, []
            last = len(tokens) - 1
            for j, t in enumerate(tokens):
                if (t if j else "\n" + t) in sound:
                    continue
                if (j == 0 and i in heads_of_cut) or (j == last and i in cut_lines):
                    continue
                around = [x.strip(EDGE).lower() for x in (*tokens[max(0, j - WINDOW) : j], *tokens[j + 1 : j + WINDOW + 1])]
                if to := self.word(t, around, first=j == 0):
                    found.append((t, to))
            if found:
                fixes.setdefault(i, []).extend(found)
        if fixes:  # cells are mended, but only words of running text and lists count; junk stays as it is
            kind = (kind or self.lines.kind(text, name)[0]) if chunk else "prose"
            fixes = {} if kind == "junk" else fixes
            noise += [(i + 1, "misread") for i in fixes if kind != "table"]
        shown = [i for i, r in enumerate(rows) if r.strip() and i not in furniture]
        return noise, self.reflow(rows, shown, joined, fixes) if repair else None

    def rest_of(self, left: str, after: list[str]) -> tuple[int, str] | None:
        """(lines away, rest of the word) of a word cut at a line end. Whatever begins the next line like the rest of a word is it; behind an intruding word or line, only what makes a known word."""
        for away, row in enumerate(after):
            for nth, token in enumerate(row.split()[:2]):
                m = FIRST.match(token)
                if not m or not any(c.isalpha() for c in m.group(1)) or not (m.group(1)[0].islower() or m.group(1)[0] in "0156989@°!+|"):
                    continue
                if away + nth == 0 or (left + self.fold(m.group(1))).lower() in self.m.known:
                    return away, m.group(1)
        return None

    def fold(self, s: str) -> str:
        return s if s.isascii() else self.rewriter.text(s)[0]

    def reflow(self, rows: list[str], flow: list[int], joined: dict[int, tuple[str, str]], fixes: dict[int, list[tuple[str, str]]]) -> str:
        """Corrected lines, with those of a paragraph joined. Items and cells keep their lines."""
        out: list[str] = []
        last, glue = None, "\n"
        forms = {i: self.lines.form(rows[i].strip()) for i in flow}
        width = max((len(rows[i]) for i in flow if forms[i] == "prose"), default=0)
        for i in flow:
            line = rows[i].strip()
            for old, new in fixes.get(i, ()):
                core = old.strip(EDGE)
                shown = new[:1].upper() + new[1:] if core[:1].isupper() else new
                line = line.replace(core, shown, 1)
            if i in joined:
                line = line[:-1] + joined[i][1]
            if last is not None:
                if glue == "" or last in joined:
                    sep = ""
                elif line.startswith(SECTION_LINE) or rows[last].startswith(SECTION_LINE):
                    sep = "\n\n" if any(not rows[j].strip() for j in range(last + 1, i)) else "\n"
                elif any(not rows[j].strip() for j in range(last + 1, i)) and not (line[:1].islower() and forms[i] == "prose" and rows[last].strip()[-1:] not in ".!?:"):
                    sep = "\n\n"
                elif forms[i] == "prose" and (forms[last] == "prose" and (rows[last].strip()[-1:] not in ".!?:" or line[:1].isdigit() or len(rows[last]) >= FULL * width) or forms[last] in ("prose", "list") and line[:1].islower()):
                    sep = " "
                else:
                    sep = "\n"
                out.append(sep)
            out.append(line)
            last, glue = i, "\n"
        return "".join(out)


def head_key(name: str | None, line: str) -> int:
    """A hash of a document's name and a line's letters."""
    h = xxhash.xxh3_64_intdigest(f"{name}\n{letters(line)}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def edge_lines(text: str) -> set[str]:
    """Letters of the first and last lines of a text that may be heads: no sentences, no section lines, 8 letters at least."""
    rows = text.split("\n")
    found: set[str] = set()
    for order in (rows, reversed(rows)):
        n = 0
        for r in order:
            r = r.strip()
            if r and not r.startswith(SECTION_LINE):
                n += 1
                if len(r) <= 160 and r[-1] not in ".,:;!?-":
                    found.add(letters(r))
                if n == EDGE_LINES:
                    break
        if n < EDGE_LINES:
            return set()
    return {x for x in found if len(x) >= 8}


def heads(df: DataFrame) -> DataFrame:
    """(name, learned): hashes of the lines that are first or last on HEAD_SHARE of a document's pages, and on HEAD_PAGES at least.

    Only chunks are parts of pages. Only hashes move; pages are made distinct before they are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, int, int | None]] = set()
            for name, page, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found.add((name, page, None))
                found.update((name, page, head_key(name, x)) for x in edge_lines(text))
            columns = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["name", "page", "mark"])

    rows = df.where("chunk and name is not null and page is not null and text <> ''").select("name", "page", "text")
    counts = rows.mapInArrow(run, "name string, page int, mark bigint").distinct().groupBy("name", "mark").agg(F.count(F.lit(1)).alias("pages"))
    marks = F.collect_list(F.when(F.col("mark").isNotNull() & (F.col("pages") >= HEAD_PAGES), F.struct("mark", "pages")))
    found = counts.groupBy("name").agg(F.max(F.when(F.col("mark").isNull(), F.col("pages"))).alias("all"), marks.alias("m"))
    return found.select("name", F.transform(F.filter("m", lambda x: x["pages"] >= HEAD_SHARE * F.col("all")), lambda x: x["mark"]).alias("learned")).where(F.size("learned") > 0)


def folded(counts: Counter) -> Counter:
    """Lower-case words without their edges, in their plain form, of raw tokens."""
    rewriter, out = Rewriter(classes({})), Counter()
    for token, n in counts.items():
        if not token.isascii():
            token = rewriter.token(token)[0]
        w = token.strip(EDGE + "!").lower()
        if 1 <= len(w) <= 40 and any(c.isalpha() for c in w):
            out[w] += n
    return out


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, summed in each task before the shuffle. Words cut at line ends are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

        def flush() -> pa.RecordBatch:
            words = folded(counts)
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=schema)

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update((CUT_WORDS.sub(" ", t) if "-\n" in t or "- \n" in t or "¬" in t else t).split())
            if len(counts) > 500_000:
                yield flush()
        yield flush()

    return df.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def context_counts(df: DataFrame, text: str, ids: dict[str, int], contexts: dict[str, int]) -> DataFrame:
    """(word, contexts, numbers): how often each context word stands within the window of a vocabulary word. A row is bounded by the context words."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((ids, contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, contexts = shared.value
        cache: dict[str, int] = {}
        context_of = np.full(len(ids) + 1, -1, dtype=np.int64)
        for w, c in contexts.items():
            context_of[ids[w]] = c
        pairs, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((pairs // CONTEXTS).astype(np.int32)), pa.array((pairs % CONTEXTS).astype(np.int32)), pa.array(numbers)], names=["word", "context", "n"])

        for b in batches:
            row: list[int] = []
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                for tok in t.split():
                    at = cache.get(tok)
                    if at is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        at = cache[tok] = ids.get(tok.strip(EDGE).lower(), -1)
                    row.append(at)
                row += [-1] * WINDOW
            a = np.array(row, dtype=np.int64)
            found = []
            for d in range(1, WINDOW + 1):
                for left, right in ((a[:-d], a[d:]), (a[d:], a[:-d])):
                    c = context_of[right]
                    ok = (left >= 0) & (c >= 0)
                    found.append(left[ok] * CONTEXTS + c[ok])
            new, n = np.unique(np.concatenate(found), return_counts=True) if found else (pairs[:0], numbers[:0])
            both = np.concatenate([pairs, new])
            pairs, where = np.unique(both, return_inverse=True)
            numbers = np.bincount(where, weights=np.concatenate([numbers, n]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) > 2_000_000:
                yield out()
                pairs, numbers = pairs[:0], numbers[:0]
        yield out()

    # Summed in each task already, so the rows move once, by word, for both aggregations.
    counts = df.select(text).mapInArrow(run, "word int, context int, n bigint").repartition("word").groupBy("word", "context").agg(F.sum("n").alias("n"))
    return counts.groupBy("word").agg(F.collect_list("context").alias("contexts"), F.collect_list("n").alias("numbers"))


def log_ratios(batch: pa.RecordBatch, by_context: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, context, value) of the positive log(#(w,c) N / (#w #c)) - log k, row after row; rows without one are left out of the last three."""
    contexts, numbers = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(batch.num_rows), np.diff(contexts.offsets.to_numpy()))
    c, n = contexts.flatten().to_numpy(), numbers.flatten().to_numpy().astype(float)
    by_word = np.bincount(row, weights=n, minlength=batch.num_rows)
    values = np.log(n * total / (by_word[row] * by_context[c])) - np.log(NEGATIVES)
    ok = values > 0
    return batch.column(0).to_numpy(), row[ok], c[ok], values[ok]


def skip_gram(counts: DataFrame, words: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors from counts (word, contexts, numbers).

    Skip-gram with k negative samples has its optimum where word times context is
    log(#(w,c) N / (#w #c)) - log k; the best vectors of a given length are the
    truncated singular vectors of that matrix. Its columns are the bounded context
    words, so the eigenvectors of a small square matrix suffice. That matrix is
    summed in the cluster, and the words' vectors are made there.
    """
    by_context = np.zeros(contexts)
    for r in counts.select(F.explode(F.arrays_zip("contexts", "numbers")).alias("p")).groupBy("p.contexts").agg(F.sum("p.numbers").alias("n")).collect():
        by_context[r.contexts] = r.n
    total = max(1, int(by_context.sum()))
    band = 64

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, any_row = np.zeros((contexts, contexts)), False
        for b in batches:
            _, row, c, values = log_ratios(b, by_context, total)
            for first in range(0, b.num_rows, 1024):  # dense rows of a bounded number of words
                inside = (row >= first) & (row < first + 1024)
                part = np.zeros((min(1024, b.num_rows - first), contexts))
                part[row[inside] - first, c[inside]] = values[inside]
                gram += part.T @ part
                any_row = True
        if any_row:
            at = np.arange(0, contexts, band)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([gram[i : i + band].tobytes() for i in at], pa.binary())], names=["at", "rows"])

    def added(batch):  # noqa: ANN001, ANN202
        total_of = sum(np.frombuffer(x, np.float64) for x in batch["rows"])
        return batch[:1].assign(rows=[total_of.astype(np.float32).tobytes()])

    gram = np.zeros((contexts, contexts))
    for r in counts.mapInArrow(products, "at int, rows binary").groupBy("at").applyInPandas(added, "at int, rows binary").collect():
        gram[r["at"] : r["at"] + band] = np.frombuffer(r["rows"], np.float32).reshape(-1, contexts)
    scale, vectors = np.linalg.eigh((gram + gram.T) / 2)
    top = np.argsort(-scale)[:DIMENSIONS]
    top = top[scale[top] > 1e-6 * max(1e-9, scale.max(initial=0))]
    basis, size = vectors[:, top], np.sqrt(np.sqrt(scale[top]))
    if not len(top):
        return np.zeros((words, 1), np.float32), np.zeros((contexts, 1), np.float32)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, row, c, values = log_ratios(b, by_context, total)
            made = np.zeros((b.num_rows, len(top)))
            np.add.at(made, row, values[:, None] * basis[c])
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array([v.tobytes() for v in (made / size).astype(np.float16)], pa.binary())], names=["word", "vector"])

    out = np.zeros((words, len(top)), np.float32)
    found = counts.mapInArrow(projected, "word int, vector binary").toArrow()
    if found.num_rows:
        out[found.column("word").to_numpy()] = np.frombuffer(b"".join(found.column("vector").to_pylist()), np.float16).reshape(-1, len(top))
    return out, (basis * size).astype(np.float32)


def learn(df: DataFrame, text: str = "text") -> Model:
    """Vocabulary and vectors from all rows of df. The vocabulary's share bounds what comes to the driver: a count and a vector for each of its words."""
    counts = stored(word_counts(df, text), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, VOCABULARY_SHARE * total)
    vocabulary = {r.word: r.n for r in counts.filter(F.col("n") >= least).collect()}
    ids = {w: i for i, w in enumerate(sorted(vocabulary))}
    contexts = {w: i for i, w in enumerate(sorted(sorted(vocabulary, key=lambda w: (-vocabulary[w], w))[:CONTEXTS]))}
    if not ids:
        return Model({}, total)
    vectors, by_context = skip_gram(stored(context_counts(df, text, ids, contexts), "contexts"), len(ids), len(contexts))
    return Model(vocabulary, total, vectors, ids, by_context, contexts)


def records(chunks: DataFrame, activities: DataFrame) -> DataFrame:
    """Chunks and annex activities as one set of records. Rows loaded twice stay; results are made distinct."""
    return chunks.select(
        F.col("chunk_id").alias("record_id"), F.col("page_content").alias("text"), F.col("document_name").alias("name"), F.col("source_organization").alias("issuer"), F.col("page_number").cast("int").alias("page"), F.lit(True).alias("chunk")
    ).unionByName(
        activities.select(
            F.col("activity_id").alias("record_id"), "text", F.col("document").alias("name"), F.lit(None).cast("string").alias("issuer"), F.col("page_number").cast("int").alias("page"), F.lit(False).alias("chunk")
        )
    )


_held: dict[str, object] = {}


def held(shared) -> Model:  # noqa: ANN001
    """The broadcast model with its indexes, made once by each worker and not by each task."""
    if _held.get("of") is not shared.value:  # a worker reads a broadcast once
        _held.update(of=shared.value, model=Model(*shared.value))
    return _held["model"]


def repaired(df: DataFrame, common: list[str], model: Model | None = None, repair: bool = True) -> DataFrame:
    """record_id, noise (array of line_no and noise) and repaired text of each row of df (as from records()).

    Misread words count only in records that are no chunks, and in chunks of prose or
    lists; in tables they are mended without being counted. Null text stays null, empty
    stays empty, both without noise. Null name, issuer or page only make heads and page
    numbers of that record unrecognisable. Whole texts are read; each row is repaired by
    itself, so repeated rows come out twice. Without repair, text is null.
    """
    model = model or learn(df)
    learned = stored(heads(df), "heads")
    small = learned.count() <= BROADCAST_ROWS
    rows = df.join(F.broadcast(learned) if small else learned, "name", "left")
    shared = df.sparkSession.sparkContext.broadcast((model.counts, model.total, model.vectors, model.ids, model.contexts, model.context_ids))
    common = frozenset(common)
    schema = T.StructType([
        T.StructField("record_id", T.StringType()),
        T.StructField("noise", T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("noise", T.StringType())]))),
        T.StructField("text", T.StringType()),
    ])
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("noise", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held(shared), common)
        for b in batches:
            found = [scanner.scan(*row, repair) for row in zip(*(b.column(i).to_pylist() for i in range(1, 7)))]
            noise = [[{"line_no": i, "noise": k} for i, k in sorted(set(f[0]))] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(noise, kind), pa.array([f[1] for f in found], pa.string())], names=schema.names)

    return rows.select("record_id", "text", "name", "issuer", "page", "chunk", "learned").mapInArrow(run, schema)
