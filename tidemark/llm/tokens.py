"""Token ids of whole texts with the tokenizers library, by words.

Byte-level BPE splits a text before every space that stands between two
non-space characters, and ids on either side don't depend on each other
there. So a group of texts is cut at its spaces, words are told apart by
128-bit hashes computed over all of its bytes at once, and only words that a
worker's bounded cache doesn't hold go to the library, many in one call."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from tidemark.llm.superminhash import BYTES, GOLDEN, _mix, _powers

TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 1_200_000  # a worker holds at most about so many, those of the last uses
JOIN_WORDS = 4_000  # new words encoded in one call
GROUP_BYTES = 2 << 20  # of texts that are encoded together
PART = 1 << 15  # bytes whose words are hashed with one run of powers
#: Latin letters and at most one of TAILS are two pieces to the
#: pre-tokenizer, and a line end between such words is one: their letters are
#: encoded apart.
TAILS = ".,!?;:"
_LETTERS = f"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([{TAILS}]?)"
SIMPLE = re.compile(f"{_LETTERS}(?:\n{_LETTERS})?")
#: White space beside a space: such a text is encoded at once.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_LOOSE = [x.encode() for c in _SPACES for x in (c + " ", " " + c)]
_ODD_SPACE = re.compile(b"|".join(re.escape(c.encode()) for c in _SPACES if c not in " \n"))
END = 0xFF  # between texts; no byte of UTF-8


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def groups(texts: Iterable) -> Iterator[list[bytes]]:
    """The strings of an Arrow column (null: empty) as UTF-8 in lists of
    about GROUP_BYTES; a longer one is alone or the last of its list."""
    held, size = [], 0
    for t in texts:
        held.append((t.as_py() or "").encode())
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hashes(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word buffer[first:last], as rows of two."""
    out = np.empty((len(first), 2), np.uint64)
    i = 0
    while i < len(first):  # words of about PART bytes at a time
        z = max(i + 1, int(np.searchsorted(first, first[i] + PART)))
        at, end = int(first[i]), int(last[z - 1])
        up, down = _powers(1 << max(PART.bit_length() + 1, (end - at).bit_length()))
        a, b, size = first[i:z] - at, last[i:z] - at, (last[i:z] - first[i:z]).astype(np.uint64)
        sums = np.zeros(end - at + 1, np.uint64)
        for k, values in enumerate((BYTES, OTHERS)):
            np.cumsum(values[buffer[at:end]] * up[:end - at], out=sums[1:])
            out[i:z, k] = _mix((sums[b] - sums[a]) * down[a] + size)
        i = z
    return out


#: Random numbers for bytes, besides BYTES.
OTHERS = _mix(BYTES + GOLDEN)


class Cache:
    """Ids of words by hash: a sorted table and one array of all ids."""

    def __init__(self):
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there, row) of each of ``hashes``."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        row = np.minimum(np.searchsorted(self.keys, hashes[:, 0]), len(self.keys) - 1)
        return (self.keys[row] == hashes[:, 0]) & (self.check[row] == hashes[:, 1]), row

    def add(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words that are not there; starts: in ``ids``."""
        by = np.argsort(hashes[:, 0])
        hashes, starts, sizes = hashes[by], starts[by], sizes[by]
        keys = np.concatenate([self.keys, hashes[:, 0]])
        by = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.check = keys[by], np.concatenate([self.check, hashes[:, 1]])[by]
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])[by]
        self.sizes = np.concatenate([self.sizes, sizes])[by]
        self.ids = np.concatenate([self.ids, ids])


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ids[start:start + size] of each row, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self.size = self._lib.get_vocab_size()  # ids are below this
        self._opens = np.array([(self._lib.id_to_token(i) or "").startswith("Ġ") for i in range(self.size)])
        #: Contents that the library takes out of a text before any piece is cut.
        self._added = [t.content.encode() for t in self._lib.get_added_tokens_decoder().values()]
        self._new, self._old = Cache(), Cache()
        self._tails = {t: self._plain(t) for t in TAILS} | {"": b""}
        self._line = self._plain("\n")

    def _plain(self, text: str) -> bytes:
        return np.array(self._lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, a space before each."""
        cores, starts, simple, others = set(), set(), [], []
        for w in words:
            if m := SIMPLE.fullmatch(w):
                parts = m.groups()
                cores.add(parts[0])
                if parts[2]:
                    starts.add(parts[2])
                simple.append(parts)
            else:
                others.append(w)
                simple.append(None)
        known, lines, tails, line = {}, {}, self._tails, self._line
        self._learn_joined([*cores, *set(others).difference(cores)], " ", known, self._opens)
        self._learn_joined(list(starts), "\n", lines, None)
        out = []
        for w, parts in zip(words, simple):
            if parts is None:
                out.append(known[w])
            else:
                a, after, b, end = parts
                out.append(known[a] + tails[after] + line + lines[b] + tails[end] if b else known[a] + tails[after])
        return out

    def _learn_joined(self, words: list[str], joint: str, known: dict, opens: np.ndarray | None) -> None:
        """Encode words joined by spaces or line ends. A word's ids begin
        with the one id that opens with the space, or follow the line end's."""
        for i in range(0, len(words), JOIN_WORDS):
            part = words[i:i + JOIN_WORDS]
            ids = np.frombuffer(self._plain(joint + joint.join(part)), "<u4")
            first = 0 if opens is not None else 1
            cuts = np.flatnonzero(opens[ids] if opens is not None else ids == np.frombuffer(self._line, "<u4")[0])
            if len(cuts) == len(part) and cuts[0] == 0:
                data, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                for w, a, b in zip(part, (4 * (cuts + first)).tolist(), ends):
                    known[w] = data[a:b]
            else:
                for w in part:
                    known[w] = self._plain(joint + w)[4 * first:]

    def _is_loose(self, raw: bytes) -> bool:
        """Whether words can't be encoded apart: white space beside a space,
        a space at an end, or an added token's content."""
        return (b"  " in raw or b" \n" in raw or b"\n " in raw or raw[:1] == b" " or raw[-1:] == b" "
                or any(x in raw for x in self._added)
                or _ODD_SPACE.search(raw) is not None and any(x in raw for x in _LOOSE))

    def encode(self, texts: list[str | bytes]) -> list[bytes]:
        raws = [t.encode() if isinstance(t, str) else t for t in texts]
        loose = [bool(r) and self._is_loose(r) for r in raws]
        tight = [r for r, x in zip(raws, loose) if r and not x]
        found = iter(self._encode_tight(tight) if tight else ())
        return [b"" if not r else self._plain(r.decode()) if x else next(found) for r, x in zip(raws, loose)]

    def _encode_tight(self, raws: list[bytes]) -> list[bytes]:
        """Texts whose spaces are single and inside: words between spaces,
        and the first word of each text, which no space precedes."""
        joined = b"\xff" + b"\xff".join(raws) + b"\xff"
        buffer = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero((buffer == 32) | (buffer == END))
        first, last = edges[:-1] + 1, edges[1:]
        spaced = buffer[edges[:-1]] == 32
        heads = np.flatnonzero(~spaced)
        head_ids = self._heads([joined[a:b].decode() for a, b in zip(first[heads].tolist(), last[heads].tolist())])
        hashes = _hashes(buffer, first[spaced], last[spaced])
        _, one, back = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
        starts, sizes, ids = self._look_up(hashes[one], joined, first[spaced][one], last[spaced][one])
        # heads and words in their order, each a range of one array of ids
        where, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        where[spaced], size[spaced] = starts[back], sizes[back]
        size[heads] = [len(x) // 4 for x in head_ids]
        where[heads] = len(ids) + np.concatenate([[0], np.cumsum(size[heads])[:-1]]).astype(np.int64)
        data = _gather(np.concatenate([ids, np.frombuffer(b"".join(head_ids), "<u4")]), where, size).astype("<u4").tobytes()
        ends = 4 * np.cumsum(size)
        cuts = [0, *ends[heads[1:] - 1].tolist(), len(data)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _heads(self, words: list[str]) -> list[bytes]:
        """Ids of first words: letters as after a line end, others one by one."""
        lines: dict[str, bytes] = {}
        parts = [SIMPLE.fullmatch(w) for w in words]
        self._learn_joined(list({m[1] for m in parts if m and not m[3]}), "\n", lines, None)
        return [lines[m[1]] + self._tails[m[2]] if m and not m[3] else self._plain(w) for w, m in zip(words, parts)]

    def _look_up(self, hashes: np.ndarray, joined: bytes, first: np.ndarray, last: np.ndarray) -> tuple:
        """(start, size, ids) of distinct words; new ones are learned, and
        those of the older cache come over to the newer."""
        if len(self._new.keys) > CACHE_WORDS // 2:
            self._old, self._new = self._new, Cache()
        there, _ = self._new.find(hashes)
        rest = np.flatnonzero(~there)
        if len(rest):
            before, row = self._old.find(hashes[rest])
            kept, lost = rest[before], rest[~before]
            row = row[before]
            gc.disable()  # this makes many small objects and no cycles
            learned = self._learn([joined[a:b].decode() for a, b in zip(first[lost].tolist(), last[lost].tolist())])
            gc.enable()
            sizes = np.concatenate([self._old.sizes[row], np.fromiter((len(x) // 4 for x in learned), np.int64, len(learned))])
            ids = np.concatenate([_gather(self._old.ids, self._old.starts[row], self._old.sizes[row]),
                                  np.frombuffer(b"".join(learned), "<u4").astype(np.uint32)])
            self._new.add(hashes[np.concatenate([kept, lost])], np.cumsum(sizes) - sizes, sizes, ids)
        _, row = self._new.find(hashes)
        return self._new.starts[row], self._new.sizes[row], self._new.ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process and tokenizer file."""
    return Encoder(path)
