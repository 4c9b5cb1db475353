"""Cross-tokenizer alignment: the groups of tokens in which two tokenizers agree.

Both tokenizers cut a text's bytes; where both cut, a group ends. A byte range of a text
gives a fragment: the tokens that end in it, with an open prefix (its first group may have
begun before), closed groups and an open suffix. Fragments compose associatively, so the
ranges of a very long text are encoded by different tasks and reduced as a tree.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import give_back, ship
from ledgerfold.session import stored

#: Characters of a text that one task encodes; longer texts are cut into ranges.
CHUNK = 1 << 15
#: Fragments that one step of the tree composes.
FAN = 8
#: Bytes of text whose links are counted together.
BLOCK = 8 << 20
#: Pieces whose tokens a worker remembers, twice as many at most, and the longest of them.
MEMO, MEMO_CHARS = 160_000, 48
#: Bytes of compressed tokens whose links are looked up at a time.
PART = 1 << 20
#: A single blank between two characters that are none: neither tokenizer has a token that
#: goes on over it (``Coder`` checks that for the vocabulary of the second).
JOINT = re.compile(r"(?<=\S) (?=\S)")
#: In a text without these, and without a blank at its ends, every blank is a joint.
NO_JOINT = re.compile(r"\s\s")


@dataclass(frozen=True)
class Vocabularies:
    """The files of the two tokenizers: A a byte-level ``.json``, B a ``.model``. ``wide``
    is for ids beyond 65,535."""

    a: str
    b: str
    wide: bool = False

    @property
    def kind(self) -> type:
        return np.uint32 if self.wide else np.uint16

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize


class Fragment(NamedTuple):
    """Token ids of a byte range as bytes of ``Vocabularies.kind``, and the numbers of tokens up
    to each common end in it, the open prefix first. What is left over is the open suffix.
    Without a common end all of it is open at both sides."""

    a: bytes
    b: bytes
    ga: tuple[int, ...]
    gb: tuple[int, ...]


EMPTY = Fragment(b"", b"", (), ())


def compose(left: Fragment, right: Fragment, width: int) -> Fragment:
    """The fragment of two adjacent ranges: the suffix of the left one and the prefix of
    the right one become one group. Associative, with ``EMPTY`` as identity. ``width`` is
    the number of bytes of an id."""
    a, b = left.a + right.a, left.b + right.b
    if not right.ga:
        return Fragment(a, b, left.ga, left.gb)
    open_a, open_b = len(left.a) // width - sum(left.ga), len(left.b) // width - sum(left.gb)
    return Fragment(a, b, (*left.ga, open_a + right.ga[0], *right.ga[1:]), (*left.gb, open_b + right.gb[0], *right.gb[1:]))


def _byte_level() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: printable
    Latin-1 bytes stand for themselves, the others for 256, 257 and so on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(c): b for b, c in [*zip(own, own), *((b, 256 + i) for i, b in enumerate(rest))]}


class Coder:
    """Both tokenizers in a worker process: A sees a blank and the text, B adds that blank
    itself."""

    def __init__(self, files: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files.a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        plain = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(plain.get(c, 63) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second vocabulary goes on over a blank: texts cannot be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if not files.wide and max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("these vocabularies need Vocabularies(wide=True)")
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.kind, self.width = files.kind, files.width
        # An id as text, with what follows it inside a group and at its end: A's, then B's.
        self.marks = pa.array([f"{i}{m}" for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(table)) for m in ends], pa.large_string())
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def forget(self) -> None:
        """Drops the memory of pieces, which only stages that encode have a use for."""
        self.recent, self.older = {}, {}
        give_back()

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind)

    def _encode(self, pieces: list[str], together: int = 64) -> dict[str, tuple]:
        """piece -> (ids of A, ids of B, its groups as text) of a blank and the piece;
        empty where the tokens' bytes are not those. Pieces are encoded ``together``, with
        joints between them, and one by one where that does not give their bytes."""
        plain = [p for p in pieces if p and p.strip() == p]
        odd = set(pieces).difference(plain) if len(plain) < len(pieces) else ()
        runs = [plain[i:i + together] for i in range(0, len(plain), together)] + [[p] for p in odd]
        texts = [" ".join(r) for r in runs]
        first = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        second = self.b.encode(texts, num_threads=1)
        found, again, good = {}, [], []
        for i, (run, text) in enumerate(zip(runs, texts)):
            raw = (" " + text).encode()
            if b"".join(map(self.a_bytes.__getitem__, first[i])) == raw and b"".join(map(self.b_bytes.__getitem__, second[i])) == raw:
                good.append(i)
            elif len(run) == 1:
                found[run[0]] = ()
            else:
                again += run
        if good:
            names = [p for i in good for p in runs[i]]
            a, b = (np.fromiter(itertools.chain.from_iterable(x[i] for i in good), self.kind) for x in (first, second))
            ends, stops = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            until = np.cumsum(pc.binary_length(pa.array(names, pa.string())).to_numpy().astype(np.int64) + 1)
            ia, ib = (np.searchsorted(x, until, side="right") for x in (ends, stops))
            text, cut = self.text(a, b, ends, stops)
            one, two, w = a.tobytes(), b.tobytes(), self.width
            i = j = k = 0
            for name, x, y, z in zip(names, (w * ia).tolist(), (w * ib).tolist(), cut[ia + ib].tolist()):
                found[name] = one[i:x], two[j:y], text[k:z]
                i, j, k = x, y, z
        return found | self._encode(again, 1) if again else found

    def text(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[str, np.ndarray]:
        """The groups of tokens that end at ``ends`` and ``stops`` as text, and where in it
        each token of the sequence begins, in which A's of a group come before B's."""
        common = np.zeros(max(ends[-1], stops[-1]) + 1, np.int8)
        common[ends] = 1
        common[stops] += 1
        last_a, last_b = common[ends] == 2, common[stops] == 2
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = max(group_a[-1], group_b[-1]) + 1
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        mark = np.empty(len(a) + len(b), np.int64)
        mark[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = a.astype(np.int64) * 2 + last_a
        mark[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = (b.astype(np.int64) + len(self.a_bytes)) * 2 + last_b
        _, offsets, data = self.marks.take(pa.array(mark)).buffers()
        cut = np.frombuffer(offsets, np.int64, len(mark) + 1)
        return str(memoryview(data)[:cut[-1]], "ascii"), cut

    def encode(self, texts: list[str]) -> list[list[tuple] | None]:
        """For each text the entries of its pieces, in order; None if one has no tokens."""
        if len(self.recent) > MEMO:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        rows = [JOINT.split(t) if t[:1] == " " or t[-1:] == " " or NO_JOINT.search(t) else t.split(" ") for t in texts]
        missing = set().union(*rows).difference(recent)
        recent.update([(p, older[p]) for p in missing if p in older])
        new = list(missing.difference(recent))
        for start in range(0, len(new), 8192):
            recent.update(self._encode(new[start:start + 8192]))
        found = [list(map(recent.__getitem__, row)) for row in rows]
        for p in [p for p in new if len(p) > MEMO_CHARS]:
            del recent[p]
        return [entries if all(entries) else None for entries in found]

    def range_of(self, window: str, low: int, high: int) -> Fragment | None:
        """The fragment of the bytes from ``low`` to ``high`` of a window that begins and
        ends at a joint or at an end of its text; None if the window has no tokens."""
        entries = self.encode([window[1:]])[0]
        if entries is None:
            return None
        a, b = (self.ids(b"".join([e[i] for e in entries])) for i in (0, 1))
        ends, stops = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        kept, held = (ends > low) & (ends <= high), (stops > low) & (stops <= high)
        a, b, ends, stops = a[kept], b[held], ends[kept], stops[held]
        common = np.intersect1d(ends, stops, assume_unique=True)
        ga, gb = (np.diff(np.searchsorted(x, common, side="right"), prepend=0).tolist() for x in (ends, stops))
        return Fragment(a.tobytes(), b.tobytes(), tuple(ga), tuple(gb))

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, end): all pairs of tokens whose bytes overlap, as A's id * 2^32 + B's, and
        where the overlap ends. Two tokens overlap in one stretch that no token ends in, so
        pairs are as many as ends."""
        ends, stops = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.sort(np.concatenate([ends, stops]), kind="stable")
        both = both[np.diff(both, prepend=-1) > 0]
        key = (a[np.searchsorted(ends, both)].astype(np.int64) << 32) | b[np.searchsorted(stops, both)]
        return key, both


def ranges(text: str, chunk: int = CHUNK) -> list[tuple[int, int, int, str]]:
    """(number, low, high, window): the byte ranges of a blank and ``text``. A range may
    begin and end anywhere, also inside a token; its window reaches out to the next joints.
    Where there is no joint within ``chunk`` characters, two ranges stay one."""
    data = " " + text
    bounds, left, right = [0], [0], []
    for at in range(chunk, len(data) - chunk // 2, chunk):
        low = max((m.start() for m in JOINT.finditer(data, max(at - chunk, 0), at + 2)), default=None)
        high = JOINT.search(data, at, at + chunk)
        if low is not None and high:
            bounds.append(at)
            left.append(low)
            right.append(high.start())
    bounds.append(len(data))
    right.append(len(data))
    rows = []
    for k, (start, to) in enumerate(zip(left, right)):
        low = len(data[start:bounds[k]].encode())
        rows.append((k, low, low + len(data[bounds[k]:bounds[k + 1]].encode()), data[start:to]))
    return rows


@functools.lru_cache(maxsize=1)
def _coder(files: Vocabularies) -> Coder:
    return Coder(files)


@functools.lru_cache(maxsize=1)
def _packers() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a worker process: to make them takes longer than a short text does."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, tokens binary, block bigint"
_FRAGMENT = "uid bigint, doc_id bigint, k int, a binary, b binary, ga array<int>, gb array<int>, ok boolean"


def _row(doc_id, a: bytes, b: bytes, n_groups: int, groups: str, width: int, block: int) -> tuple:
    n_a, n_b = len(a) // width, len(b) // width
    packed = _packers()[0].compress(n_a.to_bytes(8, "little") + a + b) if n_a else None
    sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
    return doc_id, n_a, n_b, n_groups, n_a + n_b - n_groups, sha, packed, block


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("tokens", pa.binary()), ("block", pa.int64())])
_FRAGMENT_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ga", pa.list_(pa.int32())), ("gb", pa.list_(pa.int32())), ("ok", pa.bool_())])


def _short(rows: DataFrame, files: Vocabularies) -> DataFrame:
    """Texts that one task encodes by itself, where they lie."""

    def run(batches):
        coder, number, filled = _coder(files), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            done = []
            for start in range(0, len(texts), 256):
                part = texts[start:start + 256]
                for doc_id, text, entries in zip(ids[start:start + 256], part, coder.encode(part)):
                    if not text or entries is None:
                        done.append(_row(doc_id, b"", b"", 0, "", coder.width, number))
                        continue
                    a, b, groups = zip(*entries)
                    a, b, groups = b"".join(a), b"".join(b), "".join(groups)[:-1]
                    done.append(_row(doc_id, a, b, groups.count("|"), groups, coder.width, number))
                    filled += len(text)
                    if filled > BLOCK:
                        number, filled = number + 1, 0
            yield _batch(done, _DOC_ARROW)
            give_back()

    return rows.mapInArrow(run, _DOC)


def _groups(files: Vocabularies, part: Fragment) -> list[tuple[list[int], list[int]]]:
    a, b, i, j, groups = np.frombuffer(part.a, files.kind).tolist(), np.frombuffer(part.b, files.kind).tolist(), 0, 0, []
    for x, y in zip(part.ga, part.gb):
        groups.append((a[i:i + x], b[j:j + y]))
        i, j = i + x, j + y
    return groups


def _long(rows: DataFrame, files: Vocabularies, chunk: int) -> DataFrame:
    """Texts of several ranges: the ranges are dealt out, encoded, and composed by a tree
    whose every step is one shuffle of fragments, ``FAN`` to one."""

    def cut(batches):
        shape = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("window", pa.string())])
        for batch in batches:
            for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch([(uid, doc_id, *r) for r in ranges(text, chunk)], shape)

    def encode(batches):
        coder = _coder(files)
        for batch in batches:
            done = []
            for uid, doc_id, k, low, high, window in zip(*(c.to_pylist() for c in batch.columns)):
                part = coder.range_of(window, low, high)
                done.append((uid, doc_id, k, *(part or EMPTY), part is not None))
            yield _batch(done, _FRAGMENT_ARROW)
            give_back()

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole, ok = EMPTY, True
        parts = sorted(zip(*(table[c].to_pylist() for c in ("k", "a", "b", "ga", "gb", "ok", "doc_id"))), key=lambda p: p[0])
        for _, a, b, ga, gb, fine, _ in parts:
            whole, ok = compose(whole, Fragment(a, b, tuple(ga), tuple(gb)), files.width), ok and fine
        return pa.Table.from_batches([_batch([(key[0].as_py(), parts[0][6], key[1].as_py(), *whole, ok)], _FRAGMENT_ARROW)])

    def finish(batches):
        coder = _coder(files)
        for batch in batches:
            done = []
            for uid, doc_id, a, b, ok in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "a", "b", "ok"))):
                if not ok:
                    done.append(_row(doc_id, b"", b"", 0, "", files.width, -1 - uid))
                    continue
                one, two = coder.ids(a), coder.ids(b)
                groups = coder.text(one, two, np.cumsum(coder.a_sizes[one]), np.cumsum(coder.b_sizes[two]))[0][:-1]
                done.append(_row(doc_id, a, b, groups.count("|"), groups, files.width, -1 - uid))
            yield _batch(done, _DOC_ARROW)
            give_back()

    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    windows = stored(numbered.mapInArrow(cut, "uid bigint, doc_id bigint, k int, low bigint, high bigint, window string"), "ranges")
    last = windows.agg(F.max("k")).first()[0]
    parts = windows.repartition("uid", "k").mapInArrow(encode, _FRAGMENT)
    while last:
        last //= FAN
        parts = parts.groupBy("uid", F.expr(f"k div {FAN}").cast("int").alias("parent")).applyInArrow(reduce, _FRAGMENT)
    return parts.mapInArrow(finish, _DOC)


def encoded(docs: DataFrame, files: Vocabularies, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), stored: doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256, ``tokens`` (compressed, null without tokens) and the ``block``
    of texts that it is counted with. See ``report`` for what has no tokens."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    long = F.length("text") > chunk
    return stored(_short(rows.where(long.isNull() | ~long), files).union(_long(rows.where(long), files, chunk)), "encoded")


def _unpacked(coder: Coder, tokens: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _packers()[1].decompress(tokens)
    cut = 8 + int.from_bytes(raw[:8], "little") * coder.width
    return coder.ids(raw[8:cut]), coder.ids(raw[cut:])


def groups(rows: DataFrame, files: Vocabularies) -> DataFrame:
    """The groups themselves: of ``encoded`` rows, doc_id and an array of (a, b), each the
    ids of a group in order; empty without tokens."""

    def run(batches):
        coder = _coder(files)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            lists = []
            for tokens in batch.column(1).to_pylist():
                a, b = _unpacked(coder, tokens) if tokens else (np.zeros(0, coder.kind),) * 2
                ends, stops = np.cumsum(coder.a_sizes[a]), np.cumsum(coder.b_sizes[b])
                common = np.intersect1d(ends, stops, assume_unique=True)
                ga, gb = (tuple(np.diff(np.searchsorted(x, common, side="right"), prepend=0).tolist()) for x in (ends, stops))
                lists.append([{"a": x, "b": y} for x, y in _groups(files, Fragment(a.tobytes(), b.tobytes(), ga, gb))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], names=["doc_id", "groups"])

    return rows.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>")


def _parts(tokens: list[bytes]) -> list[tuple[int, int]]:
    """Cuts (from, to) of a list of texts into parts of about ``PART`` bytes."""
    part = np.cumsum([len(t) for t in tokens]) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(tokens)]
    return list(zip(cuts, cuts[1:]))


def _joined(coder: Coder, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links of several texts, and how many the texts up to each have."""
    parts = [_unpacked(coder, t) for t in tokens]
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    key, ends = coder.links(a, b)
    sizes = np.cumsum([int(coder.a_sizes[p[0]].sum()) for p in parts])
    return key, np.searchsorted(ends, sizes, side="right")


def pairs(rows: DataFrame, files: Vocabularies) -> DataFrame:
    """The linked pairs of ids of each block, stored: block, a, b, n (links). A block is
    counted where it lies; one that is read in two parts has two rows for a pair."""
    shape = pa.schema([("block", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def counted(block: int, found: list[np.ndarray]):
        seen = pa.chunked_array([pa.array(f) for f in found]).value_counts()
        key, n = (seen.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block, np.int64)), pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], schema=shape)

    def run(batches):
        coder, found, size, at = _coder(files), [], 0, None
        coder.forget()
        for batch in batches:
            blocks, tokens = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts, cuts[1:]):
                if found and (blocks[i] != at or size > BLOCK):
                    yield counted(at, found)
                    found, size = [], 0
                at = int(blocks[i])
                for x, y in _parts(tokens[i:j]):
                    found.append(_joined(coder, tokens[i + x:i + y])[0])
                    size += len(found[-1])
            give_back()
        if found:
            yield counted(at, found)

    return stored(rows.where("tokens IS NOT NULL").select("block", "tokens").mapInArrow(run, "block bigint, a int, b int, n bigint"), "pairs")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n (links of the whole corpus) and best (n is the highest of its b), stored.
    The highest of every b go to the tasks by broadcast: at most one row for each id of
    B's vocabulary."""
    totals = stored(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    highest = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, files: Vocabularies, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links (pairs of an A and
    a B token with a common byte), n_best (links whose pair of ids has the highest count of
    all with its B id; ties count), count_sum (over links, how many links of the corpus hold
    the same pair of ids) and groups_sha256, of ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or whose tokens give other bytes than a blank and the text
    (such as those that hold U+2581 themselves), have no tokens: zeros, and an empty
    string for the digest. Repeated rows are counted as often as they stand; ids may be null.

    Nothing of a text but its compressed tokens is shuffled, once, by block; the counts
    come to the blocks by their distinct pairs, so no table of all pairs is broadcast.
    """
    rows = encoded(docs, files, chunk)
    found = pairs(rows, files)
    known = found.select("block", "a", "b").join(pair_counts(found), ["a", "b"])
    shape = pa.schema([f for f in _DOC_ARROW if f.name not in ("tokens", "block")] + [pa.field("n_best", pa.int64()), pa.field("count_sum", pa.int64())])
    columns = [f.name for f in shape][:-2]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        coder, tokens = _coder(files), left["tokens"].to_pylist()
        if not tokens:
            return shape.empty_table()
        coder.forget()
        pair = (right["a"].to_numpy().astype(np.int64) << 32) | right["b"].to_numpy().astype(np.int64)
        order = np.argsort(pair)
        pair = pair[order]
        values = [right["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64), right["n"].to_numpy()[order]]
        sums: list[list[np.ndarray]] = [[], []]
        for i, j in _parts(tokens):
            links, until = _joined(coder, tokens[i:j])
            coded = pa.array(links).dictionary_encode()
            place, at = np.searchsorted(pair, coded.dictionary.to_numpy()), coded.indices.to_numpy()
            for done, value in zip(sums, values):
                done.append(np.diff(np.concatenate([[0], np.cumsum(value[place][at])])[until], prepend=0))
        give_back()
        return left.select(columns).append_column("n_best", pa.array(np.concatenate(sums[0]))).append_column("count_sum", pa.array(np.concatenate(sums[1])))

    kinds = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    full = rows.where("tokens IS NOT NULL").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, kinds)
    zero = F.lit(0).cast("long")
    none = rows.where("tokens IS NULL").select(*columns, zero.alias("n_best"), zero.alias("count_sum"))
    return full.unionByName(none)
