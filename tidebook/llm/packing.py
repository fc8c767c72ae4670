"""Hierarchical multi-length packing of documents into token sequences.

Documents are tokenized and packed where they are read, without a shuffle. Whole long windows are cut off a document; what is left waits in the pool of
the smallest context tier that holds it. A window of a tier takes the longest piece of its pool, fills its gap with the longest pieces that fit, from its own
pool and then from those of shorter tiers, and cuts one piece to close what remains; at the end of a part the last pieces are laid into windows of powers of two, which need
no padding. Sequences of one tier form step groups of equal numbers of tokens.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .staging import short_batches, small

LONGEST = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that wait in the pool of a tier before a window is packed, in windows of that tier.
POOL = 16
#: Longest sequences of a training step; shorter ones come in as many as have the same number of tokens.
STEP = 16
#: Texts with a run of at least twice so much white space go to the tokenizer itself; the other library's search for the end of such a run needs a stack of its length.
WHITE_RUN = 4096
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_loaded: dict = {}


def _encoder(path: str):
    """A function from texts to arrays of ids; loaded once per worker process.

    A byte-level BPE file gives the same ids through tiktoken, several times faster: its vocabulary's numbers are the ranks
    of its merges. A text that holds the string of an added token, or a very long run of white space, goes to the tokenizer itself.
    """
    if path not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow: list = []  # loaded only for a text that needs it
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        # Byte-level files write each byte as a printable character: itself where it is printable, else the next from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(a in text for a in added) or _long_white(text):
                if not slow:
                    slow.append(Tokenizer.from_file(path))
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _loaded[path] = lambda texts: [encode(t) for t in texts]
    return _loaded[path]


def _long_white(text: str) -> bool:
    """Whether text may hold 2 * WHITE_RUN white characters in a row; then one aligned stretch of WHITE_RUN is all white."""
    return any(text[i : i + WHITE_RUN].isspace() for i in range(0, len(text) - WHITE_RUN + 1, WHITE_RUN))


class Packer:
    """Packs the documents of one part; take() returns finished pieces, close() the rest.

    A piece is (document number, start, length, sequence number, offset, tier). Memory: what waits in the pools, POOL windows a tier at most, and nothing
    else. Pools are sorted by length, then by document, so that a part that is computed again gives the same pieces.
    """

    def __init__(self, tiers=TIERS):
        self.tiers = tiers
        self.pool: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start)
        self.waiting: dict[int, int] = dict.fromkeys(tiers, 0)
        self.sequence = 0

    def _finish(self, tier: int, pieces: list) -> list:
        out, at = [], 0
        for doc, start, length in pieces:
            out.append((doc, start, length, self.sequence, at, tier))
            at += length
        self.sequence += 1
        return out

    def _wait(self, doc: int, start: int, length: int) -> None:
        tier = next(t for t in self.tiers if t >= length)
        insort(self.pool[tier], (length, doc, start))
        self.waiting[tier] += length

    def _draw(self, tier: int, at: int) -> tuple[int, int, int]:
        length, doc, start = self.pool[tier].pop(at)
        self.waiting[tier] -= length
        return doc, start, length

    def _window(self, tier: int) -> list:
        """A full window from the pools of tier and of shorter ones, which hold enough."""
        lower = [t for t in reversed(self.tiers) if t <= tier]
        own, gap = [], tier
        while gap:
            for t in lower:
                if (at := bisect_right(self.pool[t], (gap + 1,)) - 1) >= 0:
                    own.append(self._draw(t, at))
                    gap -= own[-1][2]
                    break
            else:
                # All that waits is longer than the gap: the shortest piece closes it, the rest of that piece waits again.
                doc, start, length = self._draw(next(t for t in reversed(lower) if self.pool[t]), 0)
                own.append((doc, start, gap))
                self._wait(doc, start + gap, length - gap)
                gap = 0
        return self._finish(tier, own)

    def take(self, doc: int, n: int) -> list:
        longest, done, start = self.tiers[-1], [], 0
        while n - start >= longest:
            done += self._finish(longest, [(doc, start, longest)])
            start += longest
        if n > start:
            self._wait(doc, start, n - start)
        for tier in self.tiers:
            while self.waiting[tier] >= POOL * tier:
                done += self._window(tier)
        return done

    def close(self) -> list:
        """Pack what waits, longest tier first; lay what no window of its tier can be filled with into powers of two."""
        done = []
        for tier in reversed(self.tiers):
            while self.pool[tier] and sum(self.waiting[t] for t in self.tiers if t <= tier) >= tier:
                done += self._window(tier)
        pieces = [self._draw(t, 0) for t in reversed(self.tiers) for _ in range(len(self.pool[t]))]
        left = sum(p[2] for p in pieces)
        while left:
            window = 1 << (min(left, self.tiers[-1]).bit_length() - 1)
            own, room = [], window
            while room:
                doc, start, length = pieces.pop(0)
                n = min(length, room)
                own.append((doc, start, n))
                if n < length:
                    pieces.insert(0, (doc, start + n, length - n))
                room -= n
            done += self._finish(window, own)
            left -= window
        return done


class Steps:
    """Numbers the step groups of a part: of each tier as many sequences as have the tokens of step longest ones.

    The last full group of a tier is held back with the one begun after it, and both are dealt evenly at the end, so that no group has less than half of the
    tokens of a step, unless its tier has fewer in the whole part. Sequences shorter than the least tier are the end of a part and share its last group.
    """

    def __init__(self, step: int = STEP, tiers=TIERS):
        self.size = {t: step * tiers[-1] // t for t in tiers}
        self.held: dict[int, list] = {t: [] for t in tiers}
        self.short: list = []
        self.group = 0

    def _number(self, sequences: list) -> list:
        out = [(*row, self.group) for rows in sequences for row in rows]
        self.group += 1
        return out

    def take(self, tier: int, rows: list) -> list:
        """rows of one sequence; returns rows with the number of their group, once it is known."""
        if tier not in self.held:
            self.short.append(rows)
            return []
        held, n = self.held[tier], self.size[tier]
        held.append(rows)
        if len(held) < 2 * n:
            return []
        self.held[tier] = held[n:]
        return self._number(held[:n])

    def close(self) -> list:
        out = []
        for tier, held in self.held.items():
            parts = -(-len(held) // self.size[tier])
            for i in range(parts):
                out += self._number(held[i * len(held) // parts : (i + 1) * len(held) // parts])
        return out + (self._number(self.short) if self.short else [])


def pack(docs: DataFrame, tokenizer: str, tiers=TIERS, end_id: int = END_ID, step: int = STEP) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most the longest tier: OUT.

    tokenizer: path of a tokenizer file, known to every executor. A document's ids are its tokens and end_id. A null or
    empty text is that one id; repeated rows are packed each; a doc_id may be null; an empty table gives no rows. Sequence
    numbers are unique over the table: the part's number above bit 33, the part's own count below. A part that is computed again
    gives the same pieces. step_group numbers groups of sequences of one tier within a part; see Steps.
    """
    if list(tiers) != sorted({1 << (t.bit_length() - 1) for t in tiers}):
        raise ValueError("tiers must be rising powers of two")
    names = [x.split()[0] for x in OUT.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in names])

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        encode, packer, groups = _encoder(tokenizer), Packer(tiers), Steps(step, tiers)
        held: dict[int, tuple] = {}  # ids of documents that still have a piece in a pool
        serial = 0

        def grouped(pieces):
            """Rows of finished sequences, whose pieces follow each other, as far as their step groups are known."""
            rows, at = [], 0
            while at < len(pieces):
                seq, tier, own = pieces[at][3], pieces[at][5], []
                while at < len(pieces) and pieces[at][3] == seq:
                    doc, start, length, _, offset, _ = pieces[at]
                    doc_id, ids = held[doc]
                    own.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), base + seq, offset, tier))
                    at += 1
                rows += groups.take(tier, own)
            return rows

        def batch(rows):
            columns = [*zip(*rows, strict=True)]
            columns[-1] = [base + g for g in columns[-1]]
            return pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), schema=schema)

        for b in small(batches):
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                    size += len(texts[end])
                    end += 1
                done = []
                for doc_id, ids in zip(doc_ids[at:end], encode(texts[at:end]), strict=True):
                    held[serial] = (doc_id, np.append(ids, np.uint32(end_id)))
                    done += packer.take(serial, len(held[serial][1]))
                    serial += 1
                if rows := grouped(done):
                    yield batch(rows)
                live = {doc for waiting in packer.pool.values() for _, doc, _ in waiting}
                held = {k: v for k, v in held.items() if k in live}
                at = end
        if rows := grouped(packer.close()) + groups.close():
            yield batch(rows)

    return short_batches(docs).select("doc_id", "text").mapInArrow(run, OUT)
