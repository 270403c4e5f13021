"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page's tree."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridscore.llm.htmlpages import labelled_pages

#: Fixed values of HTML: elements whose text isn't shown, that have no content, that are set as blocks, and, for
#: elements whose end tags may be left out, what opens when they close.
SILENT = frozenset("script style noscript template iframe textarea svg object canvas math select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>]|=\s*(["'])""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    """A run of text without a block boundary: the tags and class words above it, and how much of it is links."""

    tag: str
    above: tuple[str, ...]
    text: str = ""
    linked: int = 0


def _marks(tag: str, rest: str) -> tuple[str, ...]:
    """Features that an element gives to all blocks within it."""
    found = [f"in:{tag}"]
    if rest and "=" in rest or "hidden" in rest:
        for m in _NAMES.finditer(rest):
            found += [f"name:{w.lower()}" for w in _WORD.findall(m[1] or m[2] or m[3] or "")]
        if _HIDDEN.search(rest):
            found.append("hidden")
    return tuple(found)


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class _Scanner:
    """Tags of a page, from left to right and never back: a page is read in time that grows with its length only."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.quotes = True

    def tag_end(self, at: int) -> int:
        """Where the `>` is that ends a tag from `at` on: not one in a quoted value, unless its quote is never closed."""
        begin = at
        while self.quotes:
            m = _STOP.search(self.page, at)
            if m is None:
                # some quote is out of step: from here on quotes count for nothing, or each tag might look as far
                self.quotes = False
            elif m[1] is None:
                return m.start()
            else:
                at = self.page.index(m[1], m.end()) + 1 if self.last[m[1]] >= m.end() else m.end()
        return self.page.find(">", begin)

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, tag or text, rest): kind is text, open or close."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            mark, text_from = page.find("<", at), at
            while mark >= 0 and mark < self.last[">"] and page[mark + 1] not in "!?" and not _TAG.match(page, mark):
                mark = page.find("<", mark + 1)
            if mark < 0 or mark >= self.last[">"] and not page.startswith("<!--", mark):
                yield "text", page[text_from:], ""
                return
            if mark > text_from:
                yield "text", page[text_from:mark], ""
            if page.startswith("<!--", mark):
                stop = page.find("-->", mark + 4)
                at = stop + 3 if stop >= 0 else end
            elif page[mark + 1] in "!?":
                at = page.index(">", mark) + 1
            else:
                found = _TAG.match(page, mark)
                stop = self.tag_end(found.end())
                tag, at = found[1].lower(), stop + 1
                if page[mark + 1] == "/":
                    yield "close", tag, ""
                    continue
                rest = page[found.end() : stop]
                if tag in SILENT:
                    if not rest.endswith("/"):
                        close = _end_of(tag).search(page, at)
                        stop = page.find(">", close.end()) if close else -1
                        at = stop + 1 if stop >= 0 else end
                else:
                    yield "open", tag, rest


class _Stack:
    """Open elements: where each tag's are, where the blocks are, and how many of them give each mark."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.marks: dict[str, int] = {}

    def push(self, tag: str, rest: str) -> None:
        marks = tuple(m for m in _marks(tag, rest) if self.known is None or m in self.known)
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, marks))
        for m in marks:
            self.marks[m] = self.marks.get(m, 0) + 1

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, marks = self.open.pop()
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            for m in marks:
                self.marks[m] -= 1
                if not self.marks[m]:
                    del self.marks[m]

    def innermost(self, tag: str) -> int:
        """Depth of the innermost open element with this tag, or -1."""
        found = self.at.get(tag)
        return found[-1] if found else -1

    def make_room(self, tag: str) -> None:
        """Close what a block with this tag closes by opening, as far out as the element that holds such blocks."""
        shut = CLOSED_BY.get(tag, set()) | ({"p"} if tag != "p" or self.innermost("p") >= 0 else set())
        if tag in HOLDERS:
            holder = max(map(self.innermost, HOLDERS[tag]))
        else:
            holder = next((k for k in reversed(self.blocks) if self.open[k][0] not in shut), -1)
        inner = [positions[k] for t in shut if (positions := self.at.get(t)) and (k := bisect_right(positions, holder)) < len(positions)]
        if inner:
            self.close(min(inner))


def blocks_of(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; broken markup is read as a browser would, roughly: no end tag is required.

    With `known`, only such features of elements are kept as it holds. Time grows with the page's length, however
    broken or deep its markup is.
    """
    stack = _Stack(known)
    blocks: list[Block] = []
    texts: list[tuple[str, bool]] = []

    def flush() -> None:
        if texts:
            joined = " ".join(entities.unescape("".join(t for t, _ in texts)).split())
            if joined:
                linked = len(" ".join(entities.unescape("".join(t for t, link in texts if link)).split()))
                own = stack.open[stack.blocks[-1]][0] if stack.blocks else "body"
                blocks.append(Block(own, tuple(stack.marks), joined, linked))
            texts.clear()

    for kind, tag, rest in _Scanner(page or "").tokens():
        if kind == "text":
            texts.append((tag, stack.innermost("a") >= 0))
        elif kind == "close":
            depth = stack.innermost(tag)
            if depth >= 0:
                if stack.blocks and stack.blocks[-1] >= depth:
                    flush()
                stack.close(depth)
        else:
            if tag in BLOCKS:
                flush()
                stack.make_room(tag)
            elif tag == "br":
                texts.append((" ", False))
            if tag not in VOID:
                stack.push(tag, rest)
    flush()
    return blocks


def _size(n: int) -> str:
    return "none" if n == 0 else str(min(n.bit_length(), 9))


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has: above it, its own tag, and its text."""
    rows, heading = [], False
    for b in blocks:
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        row = [*b.above, f"tag:{b.tag}", f"words:{_size(words)}", f"links:{round(4 * share)}", "bias"]
        if b.text[-1] in ".!?…»\"'”。！？":
            row.append("sentence")
        if "©" in b.text or "(c)" in b.text[:4].lower():
            row.append("copyright")
        if sum(c.isdigit() for c in b.text[:200]) * 3 > len(b.text[:200]):
            row.append("digits")
        if "|" in b.text or "·" in b.text or "»" in b.text[:-1]:
            row.append("separators")
        row.append("after heading" if heading else "before heading")
        heading |= b.tag == "h1"
        rows.append(row)
    return rows


@dataclass
class Field:
    """Weights of a chain of two labels (0: left out, 1: main text): features by label 1, and moves between labels."""

    weights: dict[str, float]
    moves: np.ndarray

    def label(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks together (Viterbi)."""
        if not blocks:
            return []
        get, moves = self.weights.get, self.moves.tolist()
        scores = [sum(get(f, 0.0) for f in row) for row in features(blocks)]
        best, back = (0.0, scores[0]), []
        for s in scores[1:]:
            from0 = (best[0] + moves[0][0], best[1] + moves[1][0])
            from1 = (best[0] + moves[0][1], best[1] + moves[1][1])
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            best = (max(from0), max(from1) + s)
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def train(pages: list[tuple[str, list[str]]], epochs: int = 25, batch: int = 50, rate: float = 0.5, ridge: float = 1e-5) -> Field:
    """Fit a field on pages with their main blocks' texts: steps up the conditional likelihood of a few pages at a time."""
    parsed = [(features(blocks := blocks_of(page)), [int(b.text in set(main)) for b in blocks]) for page, main in pages]
    parsed = [(rows, labels) for rows, labels in parsed if rows]
    names = sorted({f for rows, _ in parsed for row in rows for f in row})
    place = {f: k for k, f in enumerate(names)}
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    speed_w, speed_m = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    batches = []
    for at in range(0, len(parsed), batch):
        part = parsed[at : at + batch]
        n, longest = len(part), max(len(rows) for rows, _ in part)
        x, y, mask = np.zeros((n, longest, len(names)), dtype=np.float32), np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
        for k, (rows, labels) in enumerate(part):
            mask[k, : len(rows)] = True
            y[k, : len(rows)] = labels
            for t, row in enumerate(rows):
                x[k, t, [place[f] for f in row]] = 1
        batches.append((x, y, mask))
    for _ in range(epochs):
        for x, y, mask in batches:
            chance, both = _marginals(x @ w, moves, mask)
            pairs = mask[:, 1:]
            seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
            slope_w = np.einsum("ntf,nt->f", x, (y - chance) * mask) / len(x) - ridge * w
            slope_m = (seen - both) / len(x) - ridge * moves
            speed_w += slope_w**2
            speed_m += slope_m**2
            w += rate * slope_w / np.sqrt(speed_w)
            moves += rate * slope_m / np.sqrt(speed_m)
    return Field({f: float(v) for f, v in zip(names, w, strict=True)}, moves)


def _marginals(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 at each block, and the expected number of each move, of pages side by side (forward-backward)."""
    n, longest = scores.shape
    s = np.stack([np.zeros((n, longest)), scores], axis=2) * mask[:, :, None]
    forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    forward[:, 0] = s[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + s[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(moves + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    whole = np.logaddexp.reduce(forward[:, -1], axis=1)
    chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) * mask
    both = np.exp(forward[:, :-1, :, None] + moves + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * mask[:, 1:, None, None]
    return chance, both.sum((0, 1))


@lru_cache(1)
def trained() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, model: Field) -> str:
    blocks = blocks_of(page, model.weights)
    return "\n\n".join(b.text for b, label in zip(blocks, model.label(blocks), strict=True) if label)


def extract(df: DataFrame, model: Field | None = None, html: str = "html") -> DataFrame:
    """df without `html`, with `text` (its main blocks, whole, parted by two line ends) and `n_chars`.

    White space inside a block is one space; character references are decoded once. Null and empty pages, and pages
    without main text, give an empty text; repeated rows get equal answers; columns named text or n_chars are
    replaced. A page is parsed and labelled within its row, without a shuffle.
    """
    field_ = model or trained()
    rest = [c for c in df.columns if c not in (html, "text", "n_chars")]
    slim = df.select(df[html].cast("string").alias("_html"), *[df[c] for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [main_text(p.as_py(), field_) for p in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    kinds = "".join(f"`{name}` {kind}, " for name, kind in slim.dtypes[1:])
    return slim.mapInArrow(run, f"{kinds}text string, n_chars long")
