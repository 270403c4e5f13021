"""SentencePiece merges with seeded dropout: segmentations that vary by seed and document and decode to the same text."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 42
#: A document's dropout key is one of so many: a hash of 64 bits.
VARIANTS = 1 << 64
#: Words of up to CACHED characters are segmented many at once; of those met twice, KEPT or so paths through their agendas are kept.
CACHED, KEPT = 40, 150_000
#: Characters of text, and words of one length, that are segmented together.
SLICE, GROUP = 1 << 19, 8192
_MASK, _START, _STOP = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_NO_KEY = -(1 << 62)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


#: Skipped merges, start << 16 | stop.
Drops = tuple[int, ...]
#: Which candidate merges (row, start, stop) are skipped.
Skip = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _limit(dropout: float) -> int:
    """Hashes below it skip their merge."""
    return min(_MASK, int(dropout * (1 << 64)))


def _hashed(keys: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of merges at these places of texts whose keys these are."""
    z = keys + start.astype(np.uint64) * np.uint64(_START) + stop.astype(np.uint64) * np.uint64(_STOP)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


class Paths:
    """Agendas of words as trees that don't depend on a key: a node is which merges were skipped so far.

    It has the merges that follow if no more are skipped, the ids that they end in, and, for each of these merges, the
    node that skipping it leads to. Words, and skips of a node, get a node when they are met the second time: most are
    met once, and running such a word's agenda with its own key costs less.
    """

    def __init__(self, tool: Pieces):
        self.tool = tool
        self.root: dict[str, int] = {}
        self.met = np.zeros(1 << 22, dtype=bool)  # by hash: a word that shares another's place is kept a little early
        self.word: list[str] = []
        self.drops: list[Drops] = []
        self.nodes = self.merges = self.all_ids = 0
        self.first_merge, self.n_merges, self.first_id, self.n_ids, self.prefix = (np.zeros(1024, dtype=np.int64) for _ in range(5))
        self.start, self.stop, self.child, self.ids = np.zeros(4096, np.int16), np.zeros(4096, np.int16), np.zeros(4096, np.int32), np.zeros(4096, np.int32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if at + len(values) > len(array):
            array = np.concatenate([array, np.zeros(max(len(array), len(values)), dtype=array.dtype)])
            setattr(self, name, array)
        array[at : at + len(values)] = values

    def _add(self, words: list[str], drops: list[Drops], prefix: np.ndarray) -> np.ndarray:
        """Nodes of words and the merges that they skip; the first `prefix` merges are those of nodes before."""
        nodes = np.zeros(len(words), dtype=np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.tool.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        skipped = np.full((len(words), max(map(len, drops), default=0)), -1, dtype=np.int64)
        for k, merges in enumerate(drops):
            skipped[k, : len(merges)] = merges
        for group, ids, n_ids, made, n_made in self.tool._agendas(symbol, np.cumsum(size) - size, size, lambda w, i, j: (skipped[w] == (i << 16 | j)[:, None]).any(1), True):
            skip = prefix[group]
            rest = _ranges(np.cumsum(n_made) - n_made + skip, n_made - skip)
            n_made = n_made - skip
            nodes[group] = np.arange(self.nodes, self.nodes + len(group))
            self.word += [words[k] for k in group.tolist()]
            self.drops += [drops[k] for k in group.tolist()]
            for name, at, values in (
                ("prefix", self.nodes, skip), ("n_merges", self.nodes, n_made), ("first_merge", self.nodes, self.merges + np.cumsum(n_made) - n_made),
                ("n_ids", self.nodes, n_ids), ("first_id", self.nodes, self.all_ids + np.cumsum(n_ids) - n_ids), ("ids", self.all_ids, ids),
                ("start", self.merges, made[0][rest]), ("stop", self.merges, made[1][rest]), ("child", self.merges, np.full(len(rest), -1)),
            ):
                self._put(name, at, values)
            self.nodes, self.merges, self.all_ids = self.nodes + len(group), self.merges + len(rest), self.all_ids + len(ids)
        return nodes

    def roots(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """The nodes of distinct words, met so many times just now, that have skipped nothing; -1: none is kept."""
        node = np.array([self.root.get(w, -1) for w in words], dtype=np.int64)
        new = np.flatnonzero(node < 0)
        place = np.array([hash(words[k]) for k in new.tolist()], dtype=np.int64) & (len(self.met) - 1)
        new, once = new[self.met[place] | (times[new] > 1)], place
        self.met[once] = True
        added = [words[k] for k in new.tolist()]
        node[new] = self._add(added, [()] * len(added), np.zeros(len(added), dtype=np.int64))
        self.root.update(zip(added, node[new].tolist(), strict=True))
        return node

    def after(self, node: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The nodes that skipping the merges in these slots leads to; -1: none is kept."""
        slots, which, times = np.unique(slot, return_index=True, return_counts=True)
        child = self.child[slots]
        make = (child < 0) & ((child == -2) | (times > 1))
        self.child[slots[(child < 0) & ~make]] = -2
        slots, parent = slots[make], node[which[make]]
        if len(slots):
            made = (self.start[slots].astype(np.int64) << 16 | self.stop[slots]).tolist()
            parents = parent.tolist()
            self.child[slots] = self._add([self.word[p] for p in parents], [(*self.drops[p], drop) for p, drop in zip(parents, made, strict=True)], self.prefix[parent] + slots - self.first_merge[parent])
        return np.maximum(self.child[slot], -1)


class Pieces:
    """The pieces of a model, with spaces for their meta symbol, and segmentation with dropout by keyed hash."""

    def __init__(self, model: str):
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_: list[bytes] = []
        self.byte_ids = [0] * 256
        self.adjacent: set[str] = set()
        for k in range(processor.vocab_size()):
            name = processor.id_to_piece(k)
            if processor.is_byte(k):
                value = int(name[3:5], 16)
                self.byte_ids[value] = k
                self.bytes_.append(bytes([value]))
            elif processor.is_control(k) or processor.is_unknown(k) or processor.is_unused(k):
                self.bytes_.append(b"")
            else:
                plain = name.replace("▁", " ")
                self.ids[plain] = k
                self.rank[plain] = -processor.get_score(k)
                self.bytes_.append(plain.encode())
                self.adjacent.update(plain[i : i + 2] for i in range(len(plain) - 1))
        self.paths = Paths(self)
        # no merge crosses a character without a piece of its own, nor the end of a word (spaces only lead in pieces),
        # nor the step from a letter to a mark, but after `joined` characters
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in self.ids)
        self.joined = {p[0] for p in self.adjacent if p[0].isalnum() | (p[0] == "_") and not (p[1].isalnum() or p[1] in "_ ")}
        self.words = re.compile(f" *[^ {alone}]+| +|[{alone}]").findall
        self.parts = re.compile(f" *[^\\w {alone}]*\\w+| *[^\\w {alone}]+| +|[{alone}]").findall
        if any(" " in plain.lstrip(" ") for plain in self.ids):
            raise ValueError("the model has pieces that go on over a space")
        # a character without a piece of its own stands as -1 - its code point until it is spelt in bytes
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for plain, k in self.ids.items():
            if len(plain) == 1:
                self.symbol[ord(plain)] = k
        lengths = np.fromiter(map(len, self.bytes_), dtype=np.int64, count=len(self.bytes_))
        self.spelt, self.spelt_from, self.spelt_n = np.frombuffer(b"".join(self.bytes_), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths
        # every way to put two pieces together into one, for lookups of whole columns of pairs by hash and linear probing
        pairs = [(self.ids[a] << 16 | self.ids[b], self.rank[plain], k) for plain, k in self.ids.items() for i in range(1, len(plain)) if (a := plain[:i]) in self.ids and (b := plain[i:]) in self.ids]
        keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self.pair_rank = np.array([p[1] for p in pairs] + [np.inf], dtype=np.float32)
        self.pair_id = np.array([p[2] for p in pairs] + [0], dtype=np.int32)
        self.slots = 1 << max(4, (8 * len(pairs)).bit_length())
        self.slot_key, self.slot_pair = np.full(self.slots, _NO_KEY, dtype=np.int64), np.full(self.slots, len(pairs), dtype=np.int32)
        left, place = np.arange(len(pairs)), self._slot(keys)
        while len(left):
            free = left[self.slot_key[place[left]] == _NO_KEY]
            self.slot_key[place[free]] = keys[free]
            won = free[self.slot_key[place[free]] == keys[free]]
            self.slot_pair[place[won]] = won
            left = np.setdiff1d(left, won)
            place[left] = (place[left] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_START) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def split(self, text: str) -> list[str]:
        """Runs that no merge crosses the ends of; finer ones recur more."""
        return self.words(text) if any(c in text for c in self.joined) else self.parts(text)

    def _merge(self, run: str, mark: int, shift: int, limit: int, out: list[int]) -> None:
        """Segment one run of any length: candidate merges leave the agenda by rank, then from the left; each is skipped by its hash."""
        rank, n = self.rank, len(run)
        if run in self.ids and n == 1:
            out.append(self.ids[run])
            return
        end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i ends; 0 once it is part of another
        before = list(range(-1, n - 1))
        agenda = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(run[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, stop = heapq.heappop(agenda)
            middle = end[i]
            if not middle or middle >= stop or end[middle] != stop:
                continue  # one of the two symbols has been merged otherwise
            if limit:
                z = (mark + (shift + i) * _START + (shift + stop) * _STOP) & _MASK
                z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _MASK
                z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _MASK
                if z ^ z >> 31 < limit:
                    continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank.get(run[i : end[stop]])) is not None:
                    heapq.heappush(agenda, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := rank.get(run[left:stop])) is not None:
                heapq.heappush(agenda, (r, left, stop))
        i = 0
        while i < n:
            symbol = run[i : end[i]]
            found = self.ids.get(symbol)
            if found is None:
                out.extend(self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass"))
            else:
                out.append(found)
            i = end[i]

    def _word(self, word: str, key: int, dropout: float, at: int = 0) -> tuple[int, ...]:
        """Ids of a word that starts `at` characters into the text of the document that has this key."""
        out: list[int] = []
        start, limit = 0, _limit(dropout)
        # no piece holds these two characters side by side, so no merge crosses them
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.adjacent:
                self._merge(word[start:i], key, at + start, limit, out)
                start = i
        self._merge(word[start:], key, at + start, limit, out)
        return tuple(out)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair of symbols merges to; an infinite rank where it doesn't."""
        sought = left.astype(np.int64) << 16 | right
        place = self._slot(sought)
        key = self.slot_key[place]
        on = np.flatnonzero((key != sought) & (key != _NO_KEY))
        while len(on):
            place[on] = (place[on] + 1) & (self.slots - 1)
            key = self.slot_key[place[on]]
            on = on[(key != sought[on]) & (key != _NO_KEY)]
        pair = self.slot_pair[place]
        return self.pair_rank[pair], self.pair_id[pair]

    def _agendas(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, skip: Skip | None, merges: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]]:
        """Segment words (symbols[first : first + size]), many of like length at once: each round, every word takes the
        first of its best-ranked candidate merges, which is made or skipped.

        Gives, for groups of words: which they are, all ids of one after another and how many each has, and, if asked
        for, the starts and stops of the merges made and how many.
        """
        order = np.argsort(size, kind="stable")
        for begin in range(0, len(order), GROUP):
            group = order[begin : begin + GROUP]
            count = size[group]
            n, longest = len(group), max(int(count[-1]), 1)
            alive = np.arange(longest) < count[:, None]
            symbol = symbols[np.minimum(first[group][:, None] + np.arange(longest), max(0, len(symbols) - 1))] if len(symbols) else np.zeros((n, longest), np.int32)
            # symbols stay at the position of their first character; after: where in the word the one after starts
            rank, into = np.full((n, longest), np.inf, dtype=np.float32), np.zeros((n, longest), dtype=np.int32)
            found = self._ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel())
            rank[:, :-1], into[:, :-1] = np.where(alive[:, 1:], found[0].reshape(n, -1), np.float32(np.inf)), found[1].reshape(n, -1)
            after = np.tile(np.arange(1, longest + 1), n)
            before = after - 2
            ranks, symbol, into, there = rank.ravel(), symbol.ravel(), into.ravel(), alive.ravel()
            live, base = np.arange(n), np.arange(n) * longest
            made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(live):
                best = (rank if len(live) == n else rank[live]).argmin(1)
                at = base[live] + best
                some = ranks[at] < np.inf
                if not some.all():
                    live, best, at = live[some], best[some], at[some]
                ranks[at], todo = np.inf, live
                gone = base[todo] + after[at]
                stop = after[gone]
                if skip is not None:
                    kept = ~skip(group[todo], best, stop)
                    if not kept.all():
                        todo, best, at, gone, stop = todo[kept], best[kept], at[kept], gone[kept], stop[kept]
                if merges:
                    made.append((todo, best, stop))
                symbol[at], after[at], there[gone], ranks[gone] = into[at], stop, False, np.inf
                more, left = stop < count[todo], before[at]
                right = base[todo[more]] + stop[more]
                before[right] = best[more]
                some = left >= 0
                left = base[todo[some]] + left[some]
                where = np.concatenate([at[more], left])
                ranks[where], into[where] = self._ranks(symbol[where], symbol[np.concatenate([right, at[some]])])
            of, start, stop = (np.concatenate([m[k] for m in made] or [live]) for k in range(3))
            by_word = np.argsort(of, kind="stable")
            yield group, symbol[there], alive.sum(1), (start[by_word], stop[by_word]), np.bincount(of, minlength=n)

    def _flat(self, words: list[str], keys: np.ndarray, starts: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """All ids of _word() of many short words, one word after another, and how many each has."""
        paths, limit = self.paths, np.uint64(_limit(dropout))
        if paths.nodes > KEPT:
            paths = self.paths = Paths(self)
        distinct = list(dict.fromkeys(words))
        which = np.fromiter(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, words), dtype=np.int64, count=len(words))
        node = paths.roots(distinct, np.bincount(which, minlength=len(distinct)))[which]
        live = np.flatnonzero(node >= 0) if limit else np.arange(0)
        while len(live):
            n = paths.n_merges[node[live]]
            slot = _ranges(paths.first_merge[node[live]], n)
            of = np.repeat(live, n)
            at = starts[of]
            skipped = np.flatnonzero(_hashed(keys[of], at + paths.start[slot], at + paths.stop[slot]) < limit)
            of, slot = of[skipped], slot[skipped]
            # the first that each word skips leads to the rest of its agenda
            first = np.diff(of, prepend=-1) != 0
            live, slot = of[first], slot[first]
            node[live] = paths.after(node[live], slot)
            live = live[node[live] >= 0]
        alone = np.flatnonzero(node < 0)
        size = np.fromiter((len(words[k]) for k in alone.tolist()), dtype=np.int64, count=len(alone))
        symbol = self.symbol[np.frombuffer("".join([words[k] for k in alone.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

        def skip(w: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            at = starts[alone[w]]
            return _hashed(keys[alone[w]], at + start, at + stop) < limit

        found = list(self._agendas(symbol, np.cumsum(size) - size, size, skip if limit else None))
        counts = paths.n_ids[node]  # of words without a node, set next
        for group, _, n_ids, _, _ in found:
            counts[alone[group]] = n_ids
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), dtype=np.int32)
        known = np.flatnonzero(node >= 0)
        flat[_ranges(first[known], counts[known])] = paths.ids[_ranges(paths.first_id[node[known]], counts[known])]
        for group, ids, n_ids, _, _ in found:
            flat[_ranges(first[alone[group]], n_ids)] = ids
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            spelt = [[self.byte_ids[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass")] for k in flat[odd].tolist()]
            owner = np.searchsorted(first + counts, odd, side="right")
            sizes = np.ones(len(flat), dtype=np.int64)
            sizes[odd] = [len(ids) for ids in spelt]
            np.add.at(counts, owner, sizes[odd] - 1)
            flat = np.repeat(flat, sizes)
            flat[flat < 0] = list(chain.from_iterable(spelt))
        return flat, counts

    def _words(self, words: list[str], key: int, dropout: float) -> list[tuple[int, ...]]:
        """_word() of many short words, each at the start of a text."""
        flat, counts = self._flat(words, np.full(len(words), key, dtype=np.uint64), np.zeros(len(words), dtype=np.int64), dropout)
        return [tuple(ids.tolist()) for ids in np.split(flat, np.cumsum(counts)[:-1])] if words else []

    def encode_flat(self, texts: list[str | None], keys: list[int], dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many texts, one text after another, and how many each has: their short words are segmented together."""
        split = [self.split(" " + t) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.concatenate([[0], np.cumsum(size)])
        word_ends = np.concatenate([[0], np.cumsum(n_words)])
        starts = ends[:-1] - np.repeat(ends[word_ends[:-1]], n_words)
        marks = np.repeat(np.array(keys, dtype=np.uint64), n_words)
        long = np.flatnonzero(size > CACHED).tolist()
        odd = [self._word(words[k], int(marks[k]), dropout, int(starts[k])) for k in long]
        for k in long:
            words[k] = ""
        flat, counts = self._flat(words, marks, starts, dropout)
        if long:
            before = np.cumsum(counts)[long]
            sizes = [len(ids) for ids in odd]
            flat = np.insert(flat, np.repeat(before, sizes), np.fromiter(chain.from_iterable(odd), dtype=np.int32, count=sum(sizes)))
            counts[long] = sizes
        ids_to = np.concatenate([[0], np.cumsum(counts)])[word_ends]
        return flat, np.diff(ids_to)

    def encode_all(self, texts: list[str | None], keys: list[int], dropout: float) -> list[list[int]]:
        """encode() of many texts."""
        flat, counts = self.encode_flat(texts, keys, dropout)
        return [ids.tolist() for ids in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []

    def encode(self, text: str | None, key: int = 0, dropout: float = 0.0) -> list[int]:
        """Ids of a text; without dropout, those that the model's own library gives. An empty text has none."""
        return self.encode_all([text], [key], dropout)[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")

    def decode_flat(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of decode() of texts whose ids, `counts` of each, stand one after another."""
        n = self.spelt_n[flat]
        data = self.spelt[_ranges(self.spelt_from[flat], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[i + 1 : j] for i, j in zip(ends, ends[1:], strict=False)]


@lru_cache(2)
def pieces_of(model: str) -> Pieces:
    return Pieces(model)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """key, pieces (ids), n_pieces and lossless (the ids decode to the text) of each row of df.

    A candidate merge is skipped by a hash of the seed, the row's key and the merge's place in the text, so documents,
    and the occurrences of a word in one document, are segmented independently, in other ways under another seed, and
    always alike on a rerun. Null texts count as empty and have no pieces; a null key has a dropout key too; repeated
    rows get equal answers. The words are segmented where the rows are, without a shuffle, and a task holds about KEPT
    paths through the agendas of short words, which depend on no key.
    """
    slim = df.select(df[key].alias("_id"), df[text].cast("string").alias("_text"), F.xxhash64(F.lit(seed), F.lit(dropout), df[key]).alias("_mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces_of(model)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            bounds = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), len(batch)]
            for i, j in zip(bounds, bounds[1:], strict=False):
                part = batch.slice(i, j - i)
                texts = part.column(1).to_pylist()
                flat, counts = tool.encode_flat(texts, [mark & _MASK for mark in part.column(2).to_pylist()], dropout)
                whole = [back == (t or "").encode() for back, t in zip(tool.decode_flat(flat, counts), texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(counts), pa.array(whole, pa.bool_())], names=["_id", "pieces", "n_pieces", "lossless"])
        tool.paths = Paths(tool)  # a worker lives on after its task

    return slim.mapInArrow(run, f"_id {dict(slim.dtypes)['_id']}, pieces array<int>, n_pieces long, lossless boolean").withColumnRenamed("_id", key)


def decode(df: DataFrame, key: str = "doc_id", pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """key and text of each row of ids; null ids count as none and give an empty text."""
    slim = df.select(df[key].alias("_id"), df[pieces].alias("_pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces_of(model)
        for batch in batches:
            texts = [tool.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return slim.mapInArrow(run, f"_id {dict(slim.dtypes)['_id']}, text string").withColumnRenamed("_id", key)
