"""A lexicon of frequent words as a minimal acyclic transducer, with the vocabulary it was made from.

Words (byte strings) and their token ids become an automaton whose states are
shared between words with equal endings. Each transition has a number; the numbers
on a word's way add up to its place among the sorted words, which names its ids.
Transitions lie in one table, in which each state has a base: the one by byte b is
at base + b if that place names the state as its own. All arrays are in one file
that workers map into memory, so that a machine holds it once.

Words that the lexicon lacks are merged by the vocabulary's rules: those of a
batch all at once, each by its own lowest rule, or, where words are long, by rules
in order of their ranks over linked lists, in time linear in the word.
"""

from __future__ import annotations

import heapq
import json
import struct

import numpy as np

#: Bytes of a word in the lexicon, at most.
LONGEST = 64
#: Words of more bytes are merged by linked lists.
SHORT = 256

_ALIGN = 64
NONE = np.iinfo(np.int64).max


# ---------------------------------------------------------------- vocabulary


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in own):
        letters[chr(256 + k)] = b
    return letters


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Arrays of a byte-level BPE file of the tokenizers library.

    ``byte_ids``: each byte's id; ``pairs``, sorted, with ``ranks`` and ``merged``
    ids; ``piece_bytes`` and ``piece_edges``: what an id stands for; ``special``:
    ids of added tokens, whose texts are their pieces. Other kinds of files are
    refused, as results would differ.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path} has no byte-level decoder")
    letters, vocab = byte_letters(), model["vocab"]
    pieces = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
    added = spec.get("added_tokens") or []
    for a in added:
        if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or any(c.isspace() for c in a["content"]):
            raise ValueError(f"the added token {a['content']!r} is of a kind that is not known here")
        pieces[a["id"]] = a["content"].encode()
    n = max(pieces) + 1
    table = [pieces.get(i, b"") for i in range(n)]
    byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    merged = np.array([vocab["".join(m)] for m in merges], np.int64)
    # A rule's parts come from earlier rules, or words would depend on the order in which pairs are looked at.
    born = {int(i): -1 for i in byte_ids}
    for rank, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), merged.tolist(), strict=True)):
        if born.get(a, rank) >= rank or born.get(b, rank) >= rank or c in born:
            raise ValueError(f"{path}: rule {rank} comes before its parts, or makes a token twice")
        born[c] = rank
    pairs = left << 32 | right
    order = np.argsort(pairs)
    return {
        "byte_ids": byte_ids,
        "pairs": pairs[order],
        "ranks": order.astype(np.int64),
        "merged": merged[order],
        "piece_bytes": np.frombuffer(b"".join(table), np.uint8),
        "piece_edges": np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64),
        "special": np.array(sorted(a["id"] for a in added), np.int64),
    }


# ---------------------------------------------------------------- automaton


def minimal_automaton(words: list[bytes]) -> list[tuple[bool, tuple]]:
    """States (final, ((byte, state), ...)) of the least automaton of sorted different words; the last is the start.

    Words come in order, so that what the next one does not share with the last is
    finished: a finished state equal to a known one is replaced by it.
    """
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    way: list[list] = [[False, []]]
    last = b""

    def finish() -> int:
        final, edges = way.pop()
        state = (final, tuple(edges))
        if state not in known:
            known[state] = len(states)
            states.append(state)
        return known[state]

    def back_to(depth: int) -> None:
        while len(way) > depth + 1:
            at = len(way) - 2
            child = finish()
            way[-1][1].append((last[at], child))

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        back_to(shared)
        way += [[False, []] for _ in word[shared:]]
        way[-1][0] = True
        last = word
    back_to(0)
    final, edges = way[0]
    states.append((final, tuple(edges)))  # the start is a state of its own
    return states


def transition_table(states: list[tuple]) -> dict[str, np.ndarray]:
    """The automaton as arrays: ``base`` and ``final`` of states, ``owner``, ``target`` and ``output`` of places."""
    counts = np.zeros(len(states), np.int64)  # words from a state on; children come before parents
    for s, (final, edges) in enumerate(states):
        counts[s] = final + sum(int(counts[t]) for _, t in edges)
    n_edges = sum(len(e) for _, e in states)
    size = 2 * n_edges + 1024
    free = np.ones(size, bool)
    free[:256] = False  # bases stay positive
    base = np.zeros(len(states), np.int32)
    owner = np.full(size, -1, np.int32)
    target, output = np.zeros(size, np.int32), np.zeros(size, np.int32)
    low = 256
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        final, edges = states[s]
        if not edges:
            break
        while not free[low]:
            low += 1
        steps = np.array([b for b, _ in edges]) - edges[0][0]
        at, place = low, -1
        while place < 0:
            if at + 4096 + 256 > size:
                more = max(size // 2, 8192)
                free = np.append(free, np.ones(more, bool))
                owner = np.append(owner, np.full(more, -1, np.int32))
                target, output = np.append(target, np.zeros(more, np.int32)), np.append(output, np.zeros(more, np.int32))
                size += more
            tries = np.flatnonzero(free[at : at + 4096]) + at
            fits = np.ones(len(tries), bool)
            for d in steps[1:]:
                fits &= free[tries + d]
            if fits.any():
                place = int(tries[fits.argmax()])
            at += 4096
        base[s] = place - edges[0][0]
        before = int(final)
        for b, t in edges:
            slot = base[s] + b
            free[slot], owner[slot], target[slot], output[slot] = False, s, t, before
            before += int(counts[t])
    used = int(np.flatnonzero(owner >= 0).max()) + 257 if n_edges else 512
    pad = lambda a, v: np.append(a, np.full(max(0, used - len(a)), v, a.dtype))[:used]
    # One state more, that nothing leaves, for words that fall out.
    return {
        "base": np.append(base, np.int32(0)),
        "final": np.array([f for f, _ in states] + [False], bool),
        "owner": pad(owner, -1),
        "target": pad(target, 0),
        "output": pad(output, 0),
    }


def places(lexicon: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's place among the lexicon's sorted words, -1 where it is not in: all words take their steps together."""
    out = np.full(len(starts), -1, np.int64)
    order = np.argsort(-np.minimum(lengths, LONGEST + 1).astype(np.int16), kind="stable")
    length = lengths[order]
    first = int(np.searchsorted(-length, -LONGEST))  # longer words are not in
    order, length = order[first:], length[first:]
    if not len(order):
        return out
    base, owner, target, output = (lexicon[k] for k in ("base", "owner", "target", "output"))
    out_of = np.int32(len(base) - 1)
    begin = starts[order]
    state = np.full(len(order), out_of - 1, np.int32)
    total = np.zeros(len(order), np.int64)
    live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    for k, n in enumerate(live.tolist()):
        at = state[:n]
        slot = base[at] + data[begin[:n] + k]
        known = owner[slot] == at
        total[:n] += np.where(known, output[slot], 0)
        state[:n] = np.where(known, target[slot], out_of)
    out[order] = np.where(lexicon["final"][state], total, -1)
    return out


# ---------------------------------------------------------------- merging


def _rule(lexicon: dict[str, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs (NONE: no rule) and the ids they merge to."""
    known = lexicon["pairs"]
    at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
    if not len(known):
        return np.full(len(pairs), NONE), np.zeros(len(pairs), np.int64)
    hit = known[at] == pairs
    return np.where(hit, lexicon["ranks"][at], NONE), lexicon["merged"][at]


def _alternate(follows: np.ndarray) -> np.ndarray:
    """Of places in order, ``follows`` if they overlap the one before: every other one of a run, the first included."""
    index = np.arange(len(follows))
    begin = np.maximum.accumulate(np.where(follows, -1, index))
    return (index - begin) % 2 == 0


def merged_short(lexicon: dict[str, np.ndarray], words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word (none is empty). In every round each word takes its lowest rule, left to right."""
    flat = lexicon["byte_ids"][np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done: list = [None] * len(words)
    while len(flat):
        pairs = flat[:-1] << 32 | flat[1:]
        rank, merged = _rule(lexicon, pairs)
        rank = np.append(np.where(of[:-1] == of[1:], rank, NONE), NONE)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        length = np.diff(np.append(first, len(of)))
        lowest = np.minimum.reduceat(rank, first)
        over = lowest == NONE
        for f, n in zip(first[over].tolist(), length[over].tolist(), strict=True):
            done[of[f]] = flat[f : f + n]
        at = np.flatnonzero((rank == np.repeat(lowest, length)) & (rank != NONE))
        at = at[_alternate(np.diff(at, prepend=-2) == 1)]
        flat[at] = merged[at]
        stays = np.repeat(~over, length)
        stays[at + 1] = False
        flat, of = flat[stays], of[stays]
    return done


def merged_long(lexicon: dict[str, np.ndarray], word: bytes) -> np.ndarray:
    """Ids of one word, by rules in order of their ranks.

    A rule's token takes part in later rules only, so that no rule comes back: each
    place is put on a rule's list when its pair arises, and looked at when the rule's
    turn comes.
    """
    ids = lexicon["byte_ids"][np.frombuffer(word, np.uint8)]
    n = len(ids)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    lists: dict[int, list[np.ndarray]] = {}
    turns: list[int] = []
    result: dict[int, tuple[int, int]] = {}

    def put(at: np.ndarray) -> None:
        pairs = ids[at] << 32 | ids[after[at]]
        rank, merged = _rule(lexicon, pairs)
        some = np.flatnonzero(rank != NONE)
        some = some[np.argsort(rank[some], kind="stable")]
        edges = np.flatnonzero(np.diff(rank[some], prepend=-1))
        for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(some)], strict=False):
            r = int(rank[some[low]])
            if r not in lists:
                lists[r] = []
                result[r] = int(pairs[some[low]]), int(merged[some[low]])
                heapq.heappush(turns, r)
            lists[r].append(at[some[low:high]])

    put(np.arange(n - 1))
    while turns:
        r = heapq.heappop(turns)
        at = np.unique(np.concatenate(lists.pop(r)))
        pair, merged = result[r]
        at = at[(ids[at] == pair >> 32) & (after[at] < n)]
        at = at[ids[after[at]] == pair & 0xFFFFFFFF]
        at = at[_alternate(np.concatenate([[False], after[at[:-1]] == at[1:]])[: len(at)])]
        if not len(at):
            continue
        gone = after[at]
        ids[at], ids[gone] = merged, -1
        after[at] = after[gone]
        inner = at[after[at] < n]
        before[after[inner]] = inner
        ahead = before[at[before[at] >= 0]]
        put(np.union1d(inner, ahead))
    return ids[ids >= 0]


def merged_words(lexicon: dict[str, np.ndarray], words: list[bytes]) -> list[np.ndarray]:
    """Ids of each of ``words``, none empty, exactly as the rules give them."""
    out: list = [None] * len(words)
    short = [k for k, w in enumerate(words) if len(w) <= SHORT]
    for k, ids in zip(short, merged_short(lexicon, [words[k] for k in short]) if short else [], strict=True):
        out[k] = ids
    for k, w in enumerate(words):
        if out[k] is None:
            out[k] = merged_long(lexicon, w)
    return out


# ---------------------------------------------------------------- the file


def compiled(vocabulary: dict[str, np.ndarray], words: list[bytes], classes: np.ndarray) -> bytes:
    """The file of the automaton of ``words``, their ids, the vocabulary, and ``classes`` of characters."""
    words = sorted(set(words))
    ids = merged_words(vocabulary, words)
    arrays = vocabulary | transition_table(minimal_automaton(words))
    arrays["word_ids"] = np.concatenate([np.zeros(0, np.int64), *ids])
    arrays["word_edges"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    arrays["classes"] = classes
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, len(a))
        raw += bytes(-len(raw) % _ALIGN)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % _ALIGN)
    return struct.pack("<q", len(text)) + text + b"".join(body)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of ``compiled``, mapped into memory."""
    whole = np.memmap(path, np.uint8, "r")
    (n,) = struct.unpack("<q", whole[:8].tobytes())
    head = json.loads(whole[8 : 8 + n].tobytes())
    body = np.asarray(whole)[8 + n :]
    return {name: body[at : at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, at, size) in head.items()}
