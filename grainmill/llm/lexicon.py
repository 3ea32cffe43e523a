"""A lexicon of frequent words with their token ids, as a minimal acyclic transducer.

States with the same right language are one state (shared prefixes and suffixes); an arc's output is the
number of words that sort before its continuation, so the outputs along a path sum to the word's index,
and the index gives the ids.  The arcs lie in one open-addressed table; a model is a handful of arrays in one file, which
workers map into memory.
"""

from __future__ import annotations

import base64
import io
import struct
import threading

import numpy as np

MAX_WORD = 64  #: Bytes; longer words are merged, not looked up.
_MIX = np.uint32(0x9E3779B1)


def _minimise(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arcs (state, byte, next, output), finality of each state, and the start state of the minimal automaton of sorted distinct words."""
    n = len(words)
    width = max(map(len, words), default=0) + 1
    mat = np.zeros((n, width), np.int16)  # bytes + 1; 0 ends a word
    for i, w in enumerate(words):
        mat[i, : len(w)] = np.frombuffer(w, np.uint8).astype(np.int16) + 1
    fresh = np.ones((n, width), bool)  # does row i start a new prefix of length d + 1?
    if n > 1:
        fresh[1:] = np.logical_or.accumulate(mat[1:] != mat[:-1], axis=1)
    fresh &= mat > 0
    node = np.zeros((n, width + 1), np.int64)  # node of the prefix of length d; 0 is the root
    count = 1
    for d in range(width):
        ids = np.cumsum(fresh[:, d]) - 1 + count
        node[:, d + 1] = np.where(mat[:, d] > 0, ids, -1)
        count += int(fresh[:, d].sum())
    i, d = np.nonzero(fresh)
    src, byte, dst = node[i, d], (mat[i, d] - 1).astype(np.int64), node[i, d + 1]
    final = np.zeros(count, bool)
    lens = np.array([len(w) for w in words], np.int64)
    if n:
        final[node[np.arange(n), lens]] = True
    # heights from the leaves up; equal (finality, arcs) at one height is one state
    order = np.argsort(-dst, kind="stable")  # children have larger ids than parents
    height = np.zeros(count, np.int64)
    depth = np.zeros(count, np.int64)
    depth[dst] = d + 1
    for k in range(width, -1, -1):
        sel = depth[dst] == k
        np.maximum.at(height, src[sel], height[dst[sel]] + 1)
    del order
    o = np.lexsort((byte, src))
    src, byte, dst = src[o], byte[o], dst[o]
    from_ = np.searchsorted(src, np.arange(count))
    to = np.searchsorted(src, np.arange(count), side="right")
    cls = np.zeros(count, np.int64)
    reps: list[int] = []
    by_height = np.argsort(height, kind="stable")
    bounds = np.searchsorted(height[by_height], np.arange(int(height.max()) + 2))
    single = (to - from_) == 1
    for h in range(int(height.max()) + 1):
        at = by_height[bounds[h] : bounds[h + 1]]
        one = at[single[at]]
        if len(one):
            key = (cls[dst[from_[one]]] << 9) | (byte[from_[one]] << 1) | final[one]
            _, firsts, inv = np.unique(key, return_index=True, return_inverse=True)
            cls[one] = inv + len(reps)
            reps.extend(one[firsts].tolist())
        seen: dict[tuple, int] = {}
        for s in at[~single[at]].tolist():
            key = (bool(final[s]), *byte[from_[s] : to[s]].tolist(), *cls[dst[from_[s] : to[s]]].tolist())
            c = seen.get(key)
            if c is None:
                c = seen[key] = len(reps)
                reps.append(s)
            cls[s] = c
    reps_a = np.array(reps, np.int64)
    k = len(reps_a)
    sizes = to[reps_a] - from_[reps_a]
    a_src = np.repeat(np.arange(k), sizes)
    idx = np.concatenate([np.arange(from_[s], to[s]) for s in reps_a]) if k else np.zeros(0, np.int64)
    a_byte, a_dst = byte[idx], cls[dst[idx]]
    # words below each state, by height
    below = np.zeros(k, np.int64)
    fin = final[reps_a]
    h_rep = height[reps_a]
    out = np.zeros(len(a_src), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    arcs_by_h = np.argsort(h_rep[a_src], kind="stable")
    hb = np.searchsorted(h_rep[a_src][arcs_by_h], np.arange(int(height.max()) + 2))
    below[sizes == 0] = fin[sizes == 0]
    for h in range(int(height.max()) + 1):
        e = np.sort(arcs_by_h[hb[h] : hb[h + 1]])
        if not len(e):
            continue
        c = np.cumsum(below[a_dst[e]])
        st = a_src[e]
        new = np.concatenate([[True], st[1:] != st[:-1]])
        base = np.repeat((c - below[a_dst[e]])[new], np.diff(np.append(np.flatnonzero(new), len(e))))
        out[e] = fin[st] + c - below[a_dst[e]] - base
        last = np.append(new[1:], True)
        below[st[last]] = (fin[st] + c - base)[last]
    del starts
    return a_src, a_byte, a_dst, out, fin, int(cls[0]) if count else 0


def compile_lexicon(words: list[bytes], ids: list[list[int]], classes: np.ndarray) -> bytes:
    """The model's file: distinct words of at most ``MAX_WORD`` bytes with their ids, and the character classes."""
    order = sorted(range(len(words)), key=words.__getitem__)
    ws = [words[i] for i in order]
    src, byte, dst, out, fin, root = _minimise(ws) if ws else (*[np.zeros(0, np.int64)] * 4, np.zeros(1, bool), 0)
    size = 1 << max(8, int(len(src) * 2).bit_length())
    if len(fin) >= 1 << 23:
        raise ValueError("the lexicon has too many states for 32-bit arcs: compile fewer words")
    keys = np.full(size, -1, np.int32)
    nxt, val = np.zeros(size, np.int32), np.zeros(size, np.int32)
    key = (src << 8) | byte
    slot = _slot(key, size)
    left = np.arange(len(key))
    while len(left):  # place all that find their slot free, move the others on
        s = slot[left]
        free = keys[s] == -1
        uniq = np.zeros(len(left), bool)
        uniq[np.unique(s, return_index=True)[1]] = True
        put = left[free & uniq]
        keys[slot[put]], nxt[slot[put]], val[slot[put]] = key[put], dst[put], out[put]
        left = left[~(free & uniq)]
        slot[left] = (slot[left] + np.uint32(1)) & np.uint32(size - 1)
    flat = [ids[i] for i in order]
    at = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    arrays = {"keys": keys, "next": nxt, "out": val, "final": fin.astype(np.uint8), "root": np.array([root], np.int64), "at": at, "ids": np.array([t for x in flat for t in x], np.int32), "classes": classes}
    buf = io.BytesIO()
    head = []
    for name, a in arrays.items():
        buf.write(b"\0" * (-buf.tell() % 8))
        head.append(f"{name} {a.dtype.str} {buf.tell()} {len(a)}")
        buf.write(np.ascontiguousarray(a).tobytes())
    h = "\n".join(head).encode()
    h += b" " * (-(len(h) + 8) % 8)
    return struct.pack("<q", len(h)) + h + buf.getvalue()


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint32) * _MIX) >> np.uint32(32 - (size.bit_length() - 1))


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        m = np.memmap(path, np.uint8, "r")
        n = struct.unpack("<q", m[:8].tobytes())[0]
        self.a = {}
        for line in m[8 : 8 + n].tobytes().decode().strip().split("\n"):
            name, dtype, at, k = line.split()
            d = np.dtype(dtype)
            lo = 8 + n + int(at)
            self.a[name] = m[lo : lo + int(k) * d.itemsize].view(d)

    @property
    def classes(self) -> np.ndarray:
        return self.a["classes"]

    def find(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The index of each word ``data[at:end]``, or -1; all words walk the automaton together, one byte a step."""
        keys, nxt, val, size = self.a["keys"], self.a["next"], self.a["out"], len(self.a["keys"])
        n = len(at)
        index = np.full(n, -1, np.int64)
        length = (end - at).astype(np.int32)
        live = np.flatnonzero(length <= MAX_WORD).astype(np.int32)
        pos = at[live].astype(np.int32 if len(data) < 1 << 31 else np.int64)
        state = np.full(len(live), int(self.a["root"][0]), np.int32)
        acc = np.zeros(len(live), np.int32)
        ln = length[live]
        step = 0
        final = self.a["final"]
        while len(live):
            key = (state << 8) | data[pos]
            s = _slot(key, size)
            k = keys[s]
            wrong = np.flatnonzero((k != key) & (k != -1))
            while len(wrong):
                s[wrong] = (s[wrong] + np.uint32(1)) & np.uint32(size - 1)
                kw = keys[s[wrong]]
                k[wrong] = kw
                wrong = wrong[(kw != key[wrong]) & (kw != -1)]
            ok = k == key
            state, acc = nxt[s], acc + val[s]
            step += 1
            pos += 1
            done = ok & (ln == step)
            if done.any():
                hit = done & (final[state] == 1)
                index[live[hit]] = acc[hit]
            keep = ok & (ln > step)
            if not keep.all():
                live, pos, state, acc, ln = live[keep], pos[keep], state[keep], acc[keep], ln[keep]
        return index


class Merger:
    """Exact byte-pair merging of single words by rank, for words outside the lexicon."""

    _made: dict[str, "Merger"] = {}
    _lock = threading.Lock()

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, word: bytes) -> list[int]:
        return self.core.encode_single_piece(word)

    @classmethod
    def of(cls, path: str) -> "Merger":
        with cls._lock:
            if path not in cls._made:
                cls._made[path] = cls(path)
            return cls._made[path]
