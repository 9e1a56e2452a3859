"""Which texts of two lists are alike enough to be scored; runs inside Spark tasks.

Keys and entries are lists of distinct texts of sorted distinct words. A pair can reach a share of
likeness in two ways. The letters of both texts in any order are common but for a few: letter counts are bits, one
for the first, second, ... letter of a kind, and so many of them differ at most. Or the shared words are so much of one
text: they include one of its first words, those without which the rest is too short, and every word it cannot do without.
No pair is kept before it passed these tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of a kind that are counted; longer texts pass without a count.
COUNTED = 65535
#: Letter counts of a text that become bits, pairs looked at once, and found pairs handed on at once.
LEVELS, AT_ONCE, FOUND = 1024, 1 << 16, 1 << 18
#: Entries per length from which lengths are looked at apart, and letters (or words) taken apart at once.
APART, LETTERS = 64, 1 << 21


def word_share(share: float) -> float:
    """Part of a text's letters that shared words must make up if they alone reach ``share``."""
    return share / (2 - share)


def _neighbours(codes: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """256 bits of each text: one for the first, second, ... time that two letters stand side by side."""
    pair = (row.astype(np.uint64) << np.uint64(32)) | (codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519))
    pair.sort()
    starts = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
    time = np.arange(len(pair)) - np.repeat(starts, np.diff(starts, append=len(pair)))
    place = (pair.astype(np.uint32) + time.astype(np.uint32) * np.uint32(40503)) * np.uint32(2654435769) >> np.uint32(24)
    bits = np.zeros((size, 256), bool)
    bits[(pair >> np.uint64(32)).astype(np.int64), place] = True
    return np.packbits(bits, axis=1).view(np.uint64)


class Texts:
    """Distinct texts with what the tests need; ``words`` are flat numbers, those of text i from ``start[i]`` on."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = texts.to_pylist()
        self.n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        counts, pairs = [], []
        cuts = np.flatnonzero(np.diff(np.cumsum(self.n + 1) // LETTERS, prepend=0)).tolist()
        for at, end in zip([0, *cuts], [*cuts, len(texts)]):
            if at == end:
                continue
            part, n = self.texts[at:end], self.n[at:end]
            # A blank before the first, between and after the last: each text owns its letters and the blank behind.
            codes = np.frombuffer((" " + " ".join(part) + " ").encode("utf-32-le"), np.uint32)
            row = np.repeat(np.arange(len(part)), n + 1)
            found = np.bincount(row * 32 + codes[1:] % 32, minlength=len(part) * 32).reshape(-1, 32)
            found[:, 0] -= 1  # the blank behind
            counts.append(np.minimum(found, COUNTED).astype(np.uint16))
            pairs.append(_neighbours(codes, row, len(part)))
        self.counts, self.pairs = np.concatenate(counts), np.concatenate(pairs)
        lists = pc.split_pattern(texts, " ")
        self.words = lists.flatten()
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.letters = pc.utf8_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(*sides: Texts) -> None:
    """Gives each distinct word of both sides a number."""
    codes = pa.concat_arrays([s.words for s in sides]).dictionary_encode().indices.to_numpy().astype(np.int64)
    kinds = int(codes.max()) + 1
    at = 0
    for s in sides:
        s.codes = codes[at : at + len(s.words)]
        at += len(s.words)
        s.seen = np.bincount(s.codes, minlength=kinds)
        # One of 64 bits for each word.
        s.bit = np.uint64(1) << ((s.codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        s.mask = np.bitwise_or.reduceat(s.bit, s.start[:-1])
        s.kinds = kinds
        s.held = np.sort(np.repeat(np.arange(len(s.n)), s.sizes) * kinds + s.codes)


def shared_letters(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the shared words of each pair, joined by blanks."""
    times = a.sizes[i]
    at = np.cumsum(times) - times
    word = np.arange(int(times.sum())) + np.repeat(a.start[i] - at, times)
    wanted = np.repeat(j, times) * b.kinds + a.codes[word]
    place = np.minimum(np.searchsorted(b.held, wanted), len(b.held) - 1)
    letters = np.add.reduceat(np.where(b.held[place] == wanted, a.letters[word] + 1, 0), at)
    return np.maximum(letters - 1, 0)


def contained(a: Texts, b: Texts, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may share words of ``word_share`` of a's letters; none twice."""
    least = word_share(share)
    row = np.repeat(np.arange(len(a.n)), a.sizes)
    needed = a.n[row] - (a.letters + 1) < a.n[row] * least - 1e-9
    must = np.bitwise_or.reduceat(np.where(needed, a.bit, np.uint64(0)), a.start[:-1])
    order = np.lexsort((a.codes, b.seen[a.codes], row))
    before = np.cumsum(a.letters[order] + 1) - (a.letters[order] + 1)
    rest = a.n[row] - (before - before[a.start[:-1]][row])  # rows stay in order
    first = np.flatnonzero(rest >= a.n[row] * least - 1e-9)
    rows, codes = row[first], a.codes[order][first]
    by_code = np.argsort(b.codes, kind="stable")
    holders = np.repeat(np.arange(len(b.n)), b.sizes)[by_code]
    starts = np.cumsum(b.seen) - b.seen
    times = b.seen[codes]
    ends = np.flatnonzero(np.diff(rows, append=-1)) + 1  # behind the last first word of each text
    total = np.cumsum(times)[ends - 1]
    text = 0
    while text < len(ends):
        # Whole texts of a, at least one, that meet about so many entries.
        before = total[text - 1] if text else 0
        upto = max(text + 1, int(np.searchsorted(total, before + AT_ONCE, "right")))
        at, end = int(ends[text - 1]) if text else 0, int(ends[upto - 1])
        if total[upto - 1] - before > len(b.n) and upto == text + 1:
            met = np.zeros(len(b.n), bool)
            for code in codes[at:end]:
                met[holders[starts[code] : starts[code] + b.seen[code]]] = True
            j = np.flatnonzero(met)
            i = np.full(len(j), rows[at])
        else:
            t = times[at:end]
            of = np.repeat(np.arange(at, end), t)
            j = holders[starts[codes[of]] + np.arange(len(of)) - np.repeat(np.cumsum(t) - t, t)]
            i = rows[of]
        kept = (b.mask[j] & must[i]) == must[i]
        i, j = i[kept], j[kept]
        if len(i):
            both = np.unique(i * len(b.n) + j)
            yield both // len(b.n), both % len(b.n)
        text = upto


def _levels(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words of 64 bits of both sides, a bit for the first, second, ... letter of a kind; the most telling bits first."""
    places = [(c, m) for c in range(a.shape[1]) for m in range(int(most[c]))]
    held = []
    for c in range(a.shape[1]):
        for side in (a, b):
            seen = np.bincount(np.minimum(side[:, c], most[c]), minlength=int(most[c]) + 1)
            held.append(np.cumsum(seen[::-1])[::-1][1:] / len(side))
    shares = np.concatenate([(p + q) / 2 for p, q in zip(held[::2], held[1::2])]) if places else np.zeros(0)
    order = np.argsort(-shares * (1 - shares), kind="stable")
    out = []
    for at in range(0, max(1, len(places)), 64):
        part = [places[k] for k in order[at : at + 64]]
        words = []
        for side in (a, b):
            bits = np.zeros((len(side), 64), bool)
            for t, (c, m) in enumerate(part):
                np.greater(side[:, c], m, out=bits[:, t])
            words.append(np.packbits(bits, axis=1).view(np.uint64)[:, 0])
        out.append(tuple(words))
    return out


def _apart(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Kinds of letters whose number differs most between texts of one length."""
    part = counts[:: max(1, len(counts) // AT_ONCE)].astype(np.float64)
    of = n[:: max(1, len(counts) // AT_ONCE)].astype(np.float64)
    left = part - np.outer(of, part.sum(axis=0) / max(1.0, of.sum()))
    return np.linalg.eigh(left.T @ left)[1][:, -1] > 0


def _nonzero(flags: np.ndarray, size: int) -> np.ndarray:
    """Places that are set among the first ``size`` flags; few are, so eight are looked at at once."""
    flags[size : size + -size % 8] = False
    words = np.flatnonzero(flags[: size + -size % 8].view(np.uint64))
    if not len(words):
        return words
    at, bit = np.nonzero(flags.reshape(-1, 8)[words])
    return words[at] * 8 + bit


def alike_slices(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, share: float, levels: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` (letter counts and lengths) that have enough letters in common."""
    if not len(a) or not len(b):
        return
    most = np.minimum(a.max(axis=0), b.max(axis=0)).astype(np.int64)
    if most.sum() > (LEVELS if levels is None else levels) or max(na.max(), nb.max()) > COUNTED:
        yield from _alike_counts(a, b, na, nb, share)
        return
    kinds = _apart(b, nb)
    own = [side[:, kinds].sum(axis=1, dtype=np.int64) for side in (a, b)]
    order = [np.lexsort((h, n)) for h, n in zip(own, (na, nb))]
    words = [(p[order[0]], q[order[1]]) for p, q in _levels(a, b, most)]
    na, nb, ha, hb = na[order[0]], nb[order[1]], own[0][order[0]], own[1][order[1]]
    # So many bits may differ: spare[0][i] + spare[1][j].
    spare = [np.minimum(side, most).sum(axis=1, dtype=np.int64)[o] - share * n for side, o, n in zip((a, b), order, (na, nb))]
    x, y, z = np.empty(AT_ONCE, np.uint64), np.empty(AT_ONCE, np.uint8), np.empty(AT_ONCE + 8, bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    span = int(hb.max()) + 1
    place = nb * span + hb
    starts = np.flatnonzero(np.diff(na, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(na)]):
        n = int(na[start])
        lo = int(np.searchsorted(nb, n * word_share(share) - 1e-6, "left"))
        hi = int(np.searchsorted(nb, n / word_share(share) + 1e-6, "right"))
        if lo >= hi:
            continue
        within = np.clip(np.floor(spare[0][start:end].max() + spare[1][lo:hi] + 1e-3) + 1, 0, 255).astype(np.uint8)
        lengths = np.unique(nb[lo:hi])
        if hi - lo >= APART * len(lengths):
            # Entries of one length stand by their letters of these kinds, of which so many may differ.
            differ = np.floor((1 - share) * (n + lengths) + 1e-3)
            groups = start + np.flatnonzero(np.diff(ha[start:end], prepend=-1))
            pieces = []
            for s, e in zip(groups, [*groups[1:], end]):
                low = np.maximum(ha[s] + np.ceil((lengths - n - differ) / 2).astype(np.int64), 0)
                high = np.minimum(ha[s] + np.floor((lengths - n + differ) / 2).astype(np.int64), span - 1)
                left, right = np.searchsorted(place, lengths * span + low, "left"), np.searchsorted(place, lengths * span + high, "right")
                pieces += [(int(s), int(e), int(p), int(q)) for p, q in zip(left, right) if q > p]
        else:
            pieces = [(int(start), int(end), lo, hi)]
        for s, e, p, q in pieces:
            wide = min(q - p, AT_ONCE)
            for c in range(p, q, wide):
                d = min(q, c + wide)
                tall = max(1, AT_ONCE // (d - c))
                for r in range(s, e, tall):
                    t = min(e, r + tall)
                    size = (t - r) * (d - c)
                    shape = (t - r, d - c)
                    xs, ys, zs = x[:size].reshape(shape), y[:size].reshape(shape), z[:size].reshape(shape)
                    np.bitwise_xor(words[0][0][r:t, None], words[0][1][None, c:d], out=xs)
                    np.bitwise_count(xs, out=ys)
                    np.less(ys, within[None, c - lo : d - lo], out=zs)
                    at = _nonzero(z, size)
                    if not len(at):
                        continue
                    i, j = r + at // (d - c), c + at % (d - c)
                    bits = y[at].astype(np.int64)
                    most_bits = spare[0][i] + spare[1][j] + 1e-3
                    for mine, other in words[1:]:
                        bits += np.bitwise_count(mine[i] ^ other[j])
                        kept = bits <= most_bits
                        i, j, bits, most_bits = i[kept], j[kept], bits[kept], most_bits[kept]
                    if len(words) == 1:
                        kept = bits <= most_bits
                        i, j = i[kept], j[kept]
                    if len(i):
                        out.append((order[0][i], order[1][j]))
                        held += len(i)
            if held >= FOUND:
                yield np.concatenate([f[0] for f in out]), np.concatenate([f[1] for f in out])
                out, held = [], 0
    if out:
        yield np.concatenate([f[0] for f in out]), np.concatenate([f[1] for f in out])


def _alike_counts(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``alike_slices``, by the counts themselves: texts of very many letters."""
    order = np.argsort(nb, kind="stable")
    b, nb = b[order], nb[order]
    tall = max(1, AT_ONCE // a.shape[1])
    for i in range(len(a)):
        lo = int(np.searchsorted(nb, na[i] * word_share(share) - 1e-6, "left"))
        hi = int(np.searchsorted(nb, na[i] / word_share(share) + 1e-6, "right"))
        for c in range(lo, hi, tall):
            d = min(hi, c + tall)
            common = np.minimum(a[i], b[c:d]).sum(axis=1, dtype=np.int64)
            j = np.flatnonzero((2 * common >= share * (na[i] + nb[c:d]) - 1e-3) | (na[i] > COUNTED) | (nb[c:d] > COUNTED))
            if len(j):
                yield np.full(len(j), i), order[c + j]


def alike(a: Texts, b: Texts, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose letters, and letters that stand side by side, can be alike enough; none twice.

    A letter that is inserted or deleted changes up to three pairs of neighbours, counted word by word with a blank before and behind.
    """
    for i, j in alike_slices(a.counts, b.counts, a.n, b.n, share):
        apart = np.bitwise_count(a.pairs[i] ^ b.pairs[j]).sum(axis=1, dtype=np.int64)
        kept = apart <= 3 * np.floor((1 - share) * (a.n[i] + b.n[j]) + 1e-3)
        if kept.any():
            yield i[kept], j[kept]


def candidates(a: Texts, b: Texts, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that can reach ``share``, none twice: by shared words that make up enough of a, else of b, else by letters."""
    numbered(a, b)
    least = word_share(share)
    for way, found in enumerate((contained(a, b, share), ((i, j) for j, i in contained(b, a, share)), alike(a, b, share))):
        for all_i, all_j in found:
            cuts = np.flatnonzero(np.diff(np.cumsum(a.sizes[all_i]) // LETTERS, prepend=0))  # of so many words at once
            for i, j in zip(np.split(all_i, cuts), np.split(all_j, cuts)):
                if not len(i):
                    continue
                shared = shared_letters(a, b, i, j)
                in_a, in_b = shared >= a.n[i] * least - 1e-9, shared >= b.n[j] * least - 1e-9
                kept = (in_a, in_b & ~in_a, ~in_a & ~in_b)[way]
                if kept.any():
                    yield i[kept], j[kept]
