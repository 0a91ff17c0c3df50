"""Byte pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

``MergeList.lookahead`` is computed from the merge list: a token's end is decided once that many symbols behind
it are known. A word therefore passes through a window of bounded size, however long it is, and its tokens are emitted
once they are stable. The windows of many words move at once in numpy (``MergeList.transduce``); a word that comes in
parts has a machine of its own (``Transducer``). A merging round replaces, in every window, all leftmost occurrences of
its pair of least rank. Results of whole words are kept in a bounded table.
``Decoder`` feeds the bytes of tokens to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .workspace import bounded, sliced

#: Words in each of two generations whose ids a worker keeps; words in use move on when the younger one is full.
KEPT_WORDS = 150_000
#: Ids decoded at a time.
DECODE_BLOCK = 1 << 16
#: Characters of the texts whose words are looked up together, at least one text, and of unknown words merged together; a
#: longer word streams by itself, so that memory does not follow a word's length.
GROUP_CHARS = 2_000_000
#: Rows that are encoded at once: the more, the more words are looked up once.
TEXT_ROWS = 256
NONE = np.int32((1 << 31) - 1)
#: Characters whose class and case are the same in all versions of Unicode at hand. Words with any other are normalised
#: and split by the tokenizer library, whose tables differ from Python's.
USUAL = "[\x00-\u052f\u2000-\u2064\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeList:
    """Merge rules over token ids, looked up in a flat hash table."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.n = max(vocab.values()) + 1
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        if min(self.inner.min(), self.last.min()) < 0:
            raise ValueError("the vocabulary lacks a byte")
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self._index()
        self.lookahead = self._lookahead()
        #: Symbols of a word that are merged at a time.
        self.window = max(4 * self.lookahead, 1024)

    def _index(self) -> None:
        bits = max(12, (len(self.rules) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        keys, ranks, made = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int64)
        seen, self.probes = set(), 1
        for rank, (a, b, ab) in enumerate(self.rules):
            if (a, b) in seen:
                continue
            seen.add((a, b))
            at, probe = self._slot(a * self.n + b), 1
            while keys[at] >= 0:
                at, probe = (at + 1) % (1 << bits), probe + 1
            keys[at], ranks[at], made[at] = a * self.n + b, rank, ab
            self.probes = max(self.probes, probe)
        self.keys, self.ranks, self.made = keys, ranks, made

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> int(self.shift)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table slot of each pair, -1 for a pair without a rule."""
        key = left * self.n + right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        got = self.keys[at]
        slot = np.where(got == key, at, -1)
        rest = np.flatnonzero((got != key) & (got >= 0))
        for step in range(1, self.probes):
            if not len(rest):
                break
            near = (at[rest] + step) % len(self.keys)
            got = self.keys[near]
            hit = got == key[rest]
            slot[rest[hit]] = near[hit]
            rest = rest[~hit & (got >= 0)]
        return slot

    def _lookahead(self) -> int:
        """Symbols behind a token's end that can bear on it.

        A rule (x, y) that begins at that end reaches len(y) symbols, and further as far as rules of lower rank
        can break up y or x. reach(t) is how far rules so far can reach beyond a token t from any place in it."""
        size = np.ones(self.n, np.int64)
        parts: dict[int, tuple[int, int]] = {}
        far = np.zeros(self.n, np.int64)  # by left token: the furthest that a rule so far reaches

        def reach(t: int) -> int:
            most, behind, todo = 0, 0, [(t, 0)]
            while todo:
                t, behind = todo.pop()
                most = max(most, int(far[t]) - behind)
                if t in parts:
                    a, b = parts[t]
                    todo += [(b, behind), (a, behind + int(size[b]))]
            return most

        most = 0
        for a, b, ab in self.rules:
            beyond = int(size[b]) + max(0, reach(b), reach(a) - int(size[b]))
            if ab not in parts:
                parts[ab], size[ab] = (a, b), size[a] + size[b]
            far[a] = max(far[a], beyond)
            most = max(most, beyond)
        self.size = size
        return most

    def merge(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges many windows at once: symbols and where each (non-empty) window starts, before and after."""
        word = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(ids))))
        done_ids, done_words = [], []
        slot = np.full(len(ids), -1, np.int64)
        if len(ids):
            slot[:-1] = np.where(word[:-1] == word[1:], self.find(ids[:-1], ids[1:]), -1)
        rank = np.where(slot >= 0, self.ranks[slot], NONE)
        while len(ids):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(ids)))
            low = np.repeat(low, length)
            over = low == NONE
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                live = ~over
                ids, word, rank, slot, low = ids[live], word[live], rank[live], slot[live], low[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low)
            # in a run of overlapping places the first, third, ... are taken
            run = np.append(True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]]))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank, slot = ids[keep], word[keep], rank[keep], slot[keep]
            # only pairs with a new symbol are looked up again
            at -= np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            slot[near], rank[near] = -1, NONE
            near = near[near < len(ids) - 1]
            near = near[word[near] == word[near + 1]]
            slot[near] = new = self.find(ids[near], ids[near + 1])
            rank[near] = np.where(new >= 0, self.ranks[new], NONE)
        if not done_ids:
            return ids, starts
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(starts)))


    def transduce(self, ids: np.ndarray, starts: np.ndarray, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many (non-empty) words at once, and where each word's begin. Each word passes through a window of
        symbols: tokens that end ``lookahead`` symbols before the window's end are stable and are emitted, the window moves
        on behind them, and what is left when the word ends is emitted as a whole."""
        window = window or self.window
        ends, at, todo, wide = np.append(starts[1:], len(ids)), starts.copy(), np.arange(len(starts)), window
        if not len(starts) or int((ends - starts).max()) <= window:
            return self.merge(ids, starts)
        out_ids, out_words = [], []
        while len(todo):
            n = np.minimum(ends[todo] - at[todo], wide)
            begin = np.cumsum(n) - n
            took, first = self.merge(ids[np.repeat(at[todo] - begin, n) + np.arange(int(n.sum()))], begin)
            word = np.repeat(np.arange(len(todo)), np.diff(np.append(first, len(took))))
            sizes = self.size[took]
            behind = np.cumsum(sizes) - np.repeat(begin, np.diff(np.append(first, len(took))))  # symbols of the window up to each token's end
            done = at[todo] + n == ends[todo]
            stable = done[word] | (behind <= (n - self.lookahead)[word])
            out_ids.append(took[stable])
            out_words.append(todo[word[stable]])
            moved = np.bincount(word[stable], sizes[stable], len(todo)).astype(np.int64)
            at[todo] += moved
            wide = window if (moved > 0).all() else wide * 2  # a token longer than the rest of a window
            todo = todo[~done]
        word, merged = np.concatenate(out_words), np.concatenate(out_ids)
        order = np.argsort(word, kind="stable")
        return merged[order], np.searchsorted(word[order], np.arange(len(starts)))


class Transducer:
    """One word that comes in parts: ``feed`` takes symbols (bytes) and yields ids once stable, ``finish`` the rest."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self.merges = merges
        self.window = window or merges.window
        self.held = b""

    def feed(self, data: bytes) -> Iterator[np.ndarray]:
        self.held += data
        wide = self.window
        while len(self.held) > wide:
            part = np.frombuffer(self.held[:wide], np.uint8)  # at least one byte follows: none of these is the last
            ids = self.merges.merge(self.merges.inner[part], np.zeros(1, np.int64))[0]
            ends = np.cumsum(self.merges.size[ids])
            stable = int(np.searchsorted(ends, len(part) - self.merges.lookahead, "right"))
            if not stable:  # a token longer than the rest of the window
                wide *= 2
                continue
            yield ids[:stable]
            self.held, wide = self.held[int(ends[stable - 1]) :], self.window

    def finish(self) -> np.ndarray:
        part, self.held = np.frombuffer(self.held, np.uint8), b""
        if not len(part):
            return np.empty(0, np.int64)
        symbols = self.merges.inner[part]
        symbols[-1] = self.merges.last[part[-1]]
        return self.merges.transduce(symbols, np.zeros(1, np.int64), self.window)[0]


@functools.cache
def classes() -> np.ndarray:
    """By code point of the basic plane: 0 for the blank, 1 letters, 2 numbers, 3 others."""
    return np.array([0 if c == 32 else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(1 << 16)], np.uint8)


def _groups(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    group, n = [], 0
    for text in texts:
        group.append(text)
        n += len(text or "")
        if n >= GROUP_CHARS:
            yield group
            group, n = [], 0
    if group:
        yield group


class Encoder:
    """Encodes texts as the tokenizer file describes: added tokens, normalizer, word pattern, byte-level merges."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.merges = MergeList(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.kind = np.dtype("<u2" if max(self.merges.n, *(i + 1 for i in self.added.values())) <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.odd = re.compile("[\x1c-\x1f]")
        self.usual = re.compile(USUAL)
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.white = regex.compile(r"[\s--\x1c-\x1f]+", regex.V1)

    def _learn(self, words: list[str]) -> None:
        if sum(map(len, words)) <= GROUP_CHARS:
            return self._learn_part(words)
        part: list[str] = []
        held = 0
        for w in words:
            held += len(w)
            part.append(w)
            if held > GROUP_CHARS:
                self._learn_part(part)
                part, held = [], 0
        self._learn_part(part)

    def _learn_part(self, words: list[str]) -> None:
        full = self.usual.fullmatch
        plain = [w for w in words if "'" not in w and (w.isascii() or full(w)) and len(w) <= GROUP_CHARS]
        if len(plain) < len(words):
            odd, known = [], set(plain)
            for w in words:
                if w not in known:
                    pieces = self._pieces(w, w.isascii() or full(w))
                    if len(w) > GROUP_CHARS:
                        self.words[w] = self._streamed(pieces)
                    else:
                        odd.append((w, [p.encode("utf-8") for p in pieces]))
            self._learn_odd(odd)
        self._learn_plain(plain)

    def _pieces(self, word: str, usual) -> Iterator[str]:
        """The pieces of a word with apostrophes (contractions), rare characters or of great length."""
        if usual:
            yield from (m[0] for m in self.pattern.finditer(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()))
        else:
            x = self.library.normalizer.normalize_str(word)
            yield from (x[a:z] for _, (a, z) in self.library.pre_tokenizer.pre_tokenize_str(x))

    def _streamed(self, pieces: Iterable[str]) -> bytes:
        """The ids of a word that is too long to be merged among others, part by part."""
        out = []
        for p in pieces:
            machine = Transducer(self.merges)
            for i in range(0, len(p), machine.window):
                out += [ids.astype(self.kind).tobytes() for ids in machine.feed(p[i : i + machine.window].encode("utf-8"))]
            out.append(machine.finish().astype(self.kind).tobytes())
        return b"".join(out)

    def _learn_odd(self, words: list[tuple[str, list[bytes]]]) -> None:
        pieces = [p for _, parts in words for p in parts]
        if pieces:
            data = np.frombuffer(b"".join(pieces), np.uint8)
            ends = np.cumsum([len(p) for p in pieces])
            symbols = self.merges.inner[data]
            symbols[ends - 1] = self.merges.last[data[ends - 1]]
            ids, at = self.merges.transduce(symbols, np.append(0, ends[:-1]))
        else:
            ids, at = np.empty(0, np.int64), np.empty(0, np.int64)
        raw, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
        cuts = [*(at * width).tolist(), len(raw)]
        done = 0
        for w, parts in words:
            self.words[w] = raw[cuts[done] : cuts[done + len(parts)]]
            done += len(parts)

    def _learn_plain(self, words: list[str]) -> None:
        """Where the class of characters changes, and around each number, a piece ends."""
        if not words:
            return
        joined = unicodedata.normalize("NFC", " ".join(words)).replace("Σ", "σ").lower()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        kind = classes()[points]
        follows = np.append(kind[1:], 0)
        ends = np.flatnonzero((kind != 0) & ((kind != follows) | (kind == 2)))
        last = np.cumsum(1 + (points >= 0x80) + (points >= 0x800))[ends] - 1  # the last byte of each piece
        word = np.cumsum(kind == 0)[ends]
        symbols = self.merges.inner[data]
        symbols[last] = self.merges.last[data[last]]
        begin = np.append(0, (last - word + 1)[:-1])  # one blank before each word but the first is left out
        ids, at = self.merges.transduce(symbols[data != 0x20], begin)
        raw, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
        cuts = [*(at[np.searchsorted(word, np.arange(len(words)))] * width).tolist(), len(raw)]
        self.words.update(zip(words, [raw[a:z] for a, z in itertools.pairwise(cuts)], strict=True))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian integers of ``kind``; null counts as empty."""
        for group in _groups(texts):
            yield from self._encode(group)

    def _cut(self, texts: list[str]) -> tuple[list[str], list[int], list[tuple[int, bytes]]]:
        """Texts without added tokens: the parts between them, how many parts each text has, and, by the part that they stand
        behind, the ids of added tokens."""
        parts, counts, marks = [], [], []
        for text in texts:
            at, n = 0, len(parts)
            for m in self.added_pattern.finditer(text):
                parts.append(text[at : m.start()])
                marks.append((len(parts) - 1, np.array([self.added[m[0]]], self.kind).tobytes()))
                at = m.end()
            parts.append(text[at:])
            counts.append(len(parts) - n)
        return parts, counts, marks

    def _encode(self, group: list[str | None]) -> list[bytes]:
        """White-space delimited words (no piece spans white space) are told apart in columns; each distinct word is looked up
        once, unknown ones are merged in one go, and their ids are copied to all places."""
        texts = [t or "" for t in group]
        marked = self.added_pattern is not None and any(map(self.added_pattern.search, texts))
        parts, counts, marks = self._cut(texts) if marked else (texts, None, [])
        if any(map(self.odd.search, parts)):
            # these four are white space to Arrow, not to the tokenizer
            words = pa.array([[w for w in self.white.split(t) if w] for t in parts], pa.large_list(pa.large_string()))
        else:
            words = pc.utf8_split_whitespace(pa.array(parts, pa.large_string()))
        offsets, flat = words.offsets.to_numpy(), words.flatten()
        kinds = flat.dictionary_encode()
        known = kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = kinds.indices.to_numpy(zero_copy_only=False).astype(np.intp)
        ids = self._look_up(known)
        width = self.kind.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        # the text before the first word and behind the last is an empty word
        empty = known.index("") if "" in known else -1
        if empty >= 0:
            sizes[empty] = 0
        flat_ids = np.frombuffer(b"".join(ids), self.kind)
        starts = np.cumsum(sizes) - sizes
        n = sizes[places]
        ends = np.cumsum(n)
        out = flat_ids[np.repeat(starts[places] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = (np.append(0, ends)[offsets - offsets[0]] * width).tolist()
        got = [out[a:z] for a, z in itertools.pairwise(cuts)]
        if not marked:
            return got
        for i, mark in marks:
            got[i] += mark
        made, at = [], 0
        for c in counts:
            made.append(b"".join(got[at : at + c]))
            at += c
        return made

    def _look_up(self, words: list[str]) -> list[bytes]:
        got = list(map(self.words.get, words))
        gaps = [i for i, ids in enumerate(got) if ids is None]
        if len(self.words) + len(gaps) > KEPT_WORDS:
            self.words, self.older = {"": b""}, self.words
        lacking = [words[i] for i in gaps]
        held = list(map(self.older.get, lacking))
        self._learn([w for w, ids in zip(lacking, held, strict=True) if ids is None])
        self.words.update((w, ids) for w, ids in zip(lacking, held, strict=True) if ids is not None)
        for i, ids in zip(gaps, map(self.words.__getitem__, lacking), strict=True):
            got[i] = ids
        return got


class Decoder:
    """Incremental byte-to-text machine over ids; ``decode`` of all ids equals feeding them in any blocks."""

    def __init__(self, spec: dict):
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError("this kind of decoder is not supported")
        # without a decoder in the file, tokens are joined by blanks as they stand
        if kind is None:
            self.pieces, self.between = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)], b" "
        else:
            back = {c: b for b, c in enumerate(byte_letters())}
            self.pieces, self.between = [bytes(back[c] for c in tokens.get(i, "")) if all(c in back for c in tokens.get(i, "")) else tokens[i].encode() for i in range(max(tokens) + 1)], b""
        self.reset()

    def reset(self) -> None:
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        data = self.between.join(map(self.pieces.__getitem__, ids.tolist()))
        data, self.begun = (self.between + data if self.begun else data), True
        return self.machine.decode(data)

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.reset()
        return out


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def loaded(content: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder a worker process and tokenizer file."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _LOADED:
        spec = json.loads(content)
        _LOADED.clear()
        _LOADED[key] = Encoder(spec), Decoder(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_column(spark: SparkSession, docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, ids (binary, little-endian) and width (bytes an id), one row a row of ``docs``.

    tokenizer: path of the file on the driver; its content (bounded: one vocabulary) goes to the workers. Kept columns named
    ids or width give way to the new ones. Null and empty texts have no ids; very long ones are encoded whole."""
    keep = [c for c in keep if c not in ("ids", "width")]
    bounded(spark)
    content = spark.sparkContext.broadcast(read_spec(tokenizer))
    schema = docs.select(*keep).schema.add("ids", "binary").add("width", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = loaded(content.value)
        for batch in sliced(batches, TEXT_ROWS):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = pa.array(list(encoder.encode(texts)), pa.binary())
            width = pa.array(np.full(len(texts), encoder.kind.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, width], [*keep, "ids", "width"])

    return docs.select(*keep, F.col(text).alias("_whole_text")).mapInArrow(run, schema)


def decode_column(spark: SparkSession, encoded: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and text of rows with ids and width, as :func:`encode_column` gives them; null ids give the empty text.
    A kept column named text gives way to the new one."""
    keep = [c for c in keep if c != "text"]
    bounded(spark)
    content = spark.sparkContext.broadcast(read_spec(tokenizer))
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = loaded(content.value)
        for batch in sliced(batches, TEXT_ROWS):
            texts = []
            for raw, width in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                ids = np.frombuffer(raw or b"", f"<u{width or 4}")
                texts.append("".join([decoder.feed(ids[i : i + DECODE_BLOCK]) for i in range(0, len(ids), DECODE_BLOCK)]) + decoder.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], [*keep, "text"])

    return encoded.select(*keep, "ids", "width").mapInArrow(run, schema)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no ids and decode to the empty text; rows are independent of each other, so
    repeated rows give equal rows; doc_id may be null. Very long texts and words are encoded whole. Other columns are ignored;
    an empty table gives no rows."""
    bounded(spark)
    content = spark.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(content.value)
        for batch in sliced(batches, TEXT_ROWS):
            texts = batch.column(1).to_pylist()
            n, encoded, decoded = [], [], []
            for raw in encoder.encode(texts):
                ids = np.frombuffer(raw, encoder.kind).astype("<u4")
                n.append(len(ids))
                encoded.append(hashlib.sha256(ids).hexdigest())
                text = hashlib.sha256()
                for i in range(0, len(ids), DECODE_BLOCK):
                    text.update(decoder.feed(ids[i : i + DECODE_BLOCK]).encode())
                text.update(decoder.finish().encode())
                decoded.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
