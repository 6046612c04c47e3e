"""Effects of all point mutations of a sequence from one pass over its pairs of sites.

What surrounds a pair and what it encloses doesn't hold the pair's own sites, so both are the same
in every mutant at these sites: they are found once for a sequence, and a mutant only changes the
pair itself and the stacks on it. Results are those of folding each mutant by itself against
every structure, in the energy model of `folding`; energies and ties are exact.

A set of structures is kept as its two lowest values. A value is the energy in hundredths times
3^length, plus the structure as digits of base 3, less than the unfolded one's by 2 at `(` and 1 at
`)`: of equal energies the first as text is lower, and values of separate sites add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .folding import HAIRPIN, INNER, MULTI, PAIRED, _stack_energies

#: Beyond any value, even with all that can be added to it; three of them still fit.
FAR = np.int64(1 << 61)
#: Sites up to which a value fits into 64 bits.
LONGEST = 30
#: Sites of the shortest helix with its hairpin, less one.
SPAN = 6

Two = tuple[np.ndarray, np.ndarray]


def _less(a: Two, b: Two) -> Two:
    """The two lowest of two sets without common members."""
    return np.minimum(a[0], b[0]), np.minimum(np.maximum(a[0], b[0]), np.minimum(a[1], b[1]))


def _take(into: Two, rows: slice, b: Two) -> None:
    """_less for some rows of a set, in place."""
    for to, x in zip(into, _less((into[0][..., rows, :], into[1][..., rows, :]), b), strict=True):
        to[..., rows, :] = x


def _sums(a: Two, b: Two) -> Two:
    """The two lowest sums of a member of each."""
    return a[0] + b[0], np.minimum(a[0] + b[1], a[1] + b[0])


def _plus(a: Two, x) -> Two:
    return a[0] + x, a[1] + x


def _cut(a: Two, *rows) -> Two:
    return a[0][slice(*rows)], a[1][slice(*rows)]


def _where(ok: np.ndarray, a: Two) -> Two:
    return np.where(ok, a[0], FAR), np.where(ok, a[1], FAR)


class Fold:
    """Coded sequences of a length, folded; sets of the stretch from site l to site l + d are row l of `[d]`, a column for each sequence.

    one, two, some: exactly one helix, two or more, one or more. starts: one helix, which starts at
    the first site. closed: a helix of two pairs or more from end to end; chain: the same, or one
    pair, as what is left of a helix. enclosed: what a helix may enclose, with that loop's energy.
    """

    def __init__(self, codes: np.ndarray, length: int):
        if length > LONGEST:
            raise ValueError(f"over {LONGEST} sites a structure and its energy don't fit into 64 bits")
        self.length, self.unit = length, np.int64(3**length)
        self.hairpin, self.inner, self.multi = (np.int64(round(100 * x)) * self.unit for x in (HAIRPIN, INNER, MULTI))
        self.can = np.zeros((4, 4), bool)
        for a, b in PAIRED:
            self.can[a, b] = True
        stacks = np.rint(_stack_energies() * 100).astype("int64")
        self.stacks, self.each = stacks.ravel(), stacks.ravel() * self.unit
        #: The same, FAR where the first or the next pair can't form.
        self.first, self.next = (np.where(ok, stacks * self.unit, FAR).ravel() for ok in (self.can[:, :, None, None], self.can[None, None]))
        self.bases = (codes[None, :] >> 2 * np.arange(length - 1, -1, -1)[:, None] & 3).astype("int64")
        place = self.place = 3 ** np.arange(length - 1, -1, -1, dtype="int64")
        #: Of pairs (l, l + d): their digits, whether they can form, and the stack of the next pair on them.
        self.pair = [(-2 * place[: length - d] - place[d:])[:, None] for d in range(length)]
        self.ok = [self.can[self.bases[: length - d], self.bases[d:]] for d in range(length)]
        self.step = [self.each[self.at(self.bases[: length - d], self.bases[d:], self.bases[1 : length - d + 1], self.bases[d - 1 : length - 1])] if d > 1 else None for d in range(length)]
        self._inside()

    @staticmethod
    def at(a, b, c, d):
        """Place of a stack of pair (c, d) on pair (a, b) in the flat table."""
        return a << 6 | b << 4 | c << 2 | d

    def none(self, d: int) -> Two:
        shape = (self.length - d, self.bases.shape[1])
        return np.full(shape, FAR), np.full(shape, FAR)

    def _inside(self) -> None:
        self.one, self.two, self.some, self.starts, self.closed, self.chain, self.enclosed = ([] for _ in range(7))
        for d in range(self.length):
            closed, chain, starts, two, one, enclosed = (self.none(d) for _ in range(6))
            if d >= SPAN:
                closed = _where(self.ok[d], _plus(_cut(self.chain[d - 2], 1, -1), self.step[d] + self.pair[d]))
            if d >= SPAN - 2:
                chain = _less(_where(self.ok[d], _plus(_cut(self.enclosed[d - 2], 1, -1), self.pair[d])), closed)
            if d >= 2:
                enclosed[0][:] = self.hairpin
            if d >= SPAN:
                after, before = _cut(self.one[d - 1], 1, None), _cut(self.starts[d - 1], 0, -1)
                starts = _less(before, closed)
                one = _less(after, starts)
                two = _cut(self.two[d - 1], 1, None)
                for e in range(SPAN, d - SPAN):
                    two = _less(two, _sums(_cut(self.closed[e], 0, self.length - d), _cut(self.some[d - e - 1], e + 1, None)))
                # One helix from end to end would be the same helix as the one around.
                enclosed = _less(_less(enclosed, _plus(_less(after, before), self.inner)), _plus(two, self.multi))
            for kept, x in ((self.closed, closed), (self.chain, chain), (self.starts, starts), (self.one, one), (self.two, two), (self.some, _less(one, two) if d >= SPAN else one), (self.enclosed, enclosed)):
                kept.append(x)
        n = self.bases.shape[1]
        unfolded = np.zeros((1, n), "int64"), np.full((1, n), FAR)
        #: The two lowest of all structures.
        self.lowest = tuple(x[0] for x in _less(_less(self.one[-1], self.two[-1]), unfolded))

    def energy(self, values: np.ndarray) -> np.ndarray:
        return -(-values // self.unit)

    def only(self, kept: np.ndarray) -> None:
        """Goes on with some of the sequences."""
        for sets in (self.one, self.two, self.some, self.starts, self.closed, self.chain, self.enclosed):
            sets[:] = [(a[:, kept], b[:, kept]) for a, b in sets]
        self.ok, self.step = [x[:, kept] for x in self.ok], [x if x is None else x[:, kept] for x in self.step]
        self.bases, self.lowest = self.bases[:, kept], (self.lowest[0][kept], self.lowest[1][kept])

    def mutants(self) -> Two:
        """The two lowest of every mutant, [turn - 1, site] and a column for each sequence; a turn makes a base b to b xor turn.

        From long stretches to short ones: what can stand around a stretch's set of a name is found from
        what can stand around the longer sets that hold it.
        """
        length, n = self.length, self.bases.shape[1]
        free = np.zeros((length, n), "int64"), np.full((length, n), FAR)  # structures that leave the site unpaired
        paired = np.full((3, length, n), FAR), np.full((3, length, n), FAR)  # structures in which the mutated site has a partner
        one, bare, two, starts, chain, long = ({} for _ in range(6))  # bare: `one` where it is all that a helix encloses
        covered = None
        for d in range(length - 1, -1, -1):
            around = self.none(d)  # helices of two pairs or more that enclose the stretch
            if d + 2 in long:
                _take(around, slice(1, -1), long[d + 2])
            loop = _plus(around, self.hairpin) if d >= 2 else around
            if covered is not None:
                _take(loop, slice(0, -1), covered)
            covered = loop  # hairpins from site l to site l + d or further
            _take(free, slice(d, None), covered)
            closed = None
            if d >= SPAN:
                some, closed = self.none(d), self.none(d)
                if d == length - 1:
                    some[0][:] = 0  # the whole sequence
                for e in range(SPAN, length - 1 - d):
                    _take(some, slice(e + 1, None), _sums(two[d + e + 1], _cut(self.closed[e], 0, length - d - e - 1)))
                    _take(closed, slice(0, length - d - e - 1), _sums(two[d + e + 1], _cut(self.some[e], d + 1, None)))
                one[d], bare[d], two[d], starts[d] = some, _plus(around, self.inner), _less(some, _plus(around, self.multi)), self.none(d)
                if d < length - 1:
                    one[d] = tuple(x.copy() for x in some)
                    _take(one[d], slice(1, None), _less(one[d + 1], bare[d + 1]))
                    _take(two[d], slice(1, None), two[d + 1])
                    _take(starts[d], slice(0, -1), _less(starts[d + 1], bare[d + 1]))
                starts[d] = _less(starts[d], one[d])
                closed = _less(closed, starts[d])
                # The site that is left unpaired at an end of a stretch.
                _take(free, slice(0, length - d), _sums(_less(one[d], bare[d]), _cut(self.one[d - 1], 1, None)))
                _take(free, slice(0, length - d), _sums(two[d], _cut(self.two[d - 1], 1, None)))
                _take(free, slice(d, None), _sums(_less(starts[d], bare[d]), _cut(self.starts[d - 1], 0, -1)))
            if d >= SPAN - 2:
                self._at_pairs(d, closed, chain, long, paired)
        return _less(paired, free)

    def _at_pairs(self, d: int, closed: Two | None, chain: dict[int, Two], long: dict[int, Two], paired: Two) -> None:
        """What is around helices down to pairs (l, l + d) and with them: chain, and long, of two pairs or more. Mutants at both sites of the pairs: paired.

        closed: what is around helices that begin with these pairs, None if they are too short for that.
        """
        size, mid, key = self.length - d, slice(1, -1), self.pair[d]
        long[d] = self.none(d)
        if size > 2:
            _take(long[d], mid, _where(self.ok[d][mid], _plus(chain[d + 2], self.step[d + 2] + key[mid])))
        chain[d] = long[d] if closed is None else _less(_where(self.ok[d], _plus(closed, key)), long[d])
        cut = lambda a: (np.minimum(a[0], FAR), np.minimum(a[1], FAR))
        # Without the pair itself and the stacks on it: the pair is a helix's first, neither, or its last.
        first = None if closed is None else cut(_plus(_sums(closed, _cut(self.chain[d - 2], 1, -1)), key))
        if size > 2:
            neither = cut(_plus(_sums(chain[d + 2], _cut(self.chain[d - 2], 2, -2)), key[mid]))
            last = cut(_plus(_sums(chain[d + 2], _cut(self.enclosed[d - 2], 2, -2)), key[mid]))
        b, turns = self.bases, np.arange(1, 4)[:, None, None]
        for sites in (slice(0, size), slice(d, None)):
            left, right = (b[part] ^ turns if part == sites else b[part][None] for part in (slice(0, size), slice(d, None)))
            inner = self.first[self.at(left, right, b[1 : size + 1], b[d - 1 : -1])]
            found = (np.full_like(inner, FAR), np.full_like(inner, FAR)) if first is None else _plus(first, inner)
            if size > 2:
                outer = self.next[self.at(b[: size - 2], b[d + 2 :], left[:, mid], right[:, mid])]
                _take(found, mid, _plus(_less(_plus(neither, inner[:, mid]), last), outer))
            _take(paired, sites, found)

    def partners(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[site], a column for each value: 0 to 2 for `(`, `)` and `.` of the value's structure, and the partner, -1 without one."""
        digits = (values - self.energy(values) * self.unit + self.unit - 1)[None, :] // self.place[:, None] % 3
        partner, n = np.full(digits.shape, -1), digits.shape[1]
        opened, depth = np.zeros((self.length + 1, n), "int64"), np.zeros(n, "int64")
        for k in range(self.length):
            at = np.flatnonzero(digits[k] == 0)
            opened[depth[at], at] = k
            depth[at] += 1
            at = np.flatnonzero(digits[k] == 1)
            depth[at] -= 1
            other = opened[depth[at], at]
            partner[k, at], partner[other, at] = other, k
        return digits, partner

    def held(self, partner: np.ndarray) -> np.ndarray:
        """What a turn at a site adds to the energy of the sequence's structure, in hundredths, infinite where it breaks a pair; [turn - 1, site]."""
        site, col, b = np.arange(self.length)[:, None], np.arange(partner.shape[1]), self.bases
        other = np.where(partner < 0, site, partner)
        lo, hi = np.minimum(site, other), np.maximum(site, other)
        up, down, over, under = np.maximum(lo - 1, 0), np.minimum(lo + 1, self.length - 1), np.minimum(hi + 1, self.length - 1), np.maximum(hi - 1, 0)
        outer, inner = (lo > 0) & (hi < self.length - 1) & (partner[up, col] == over), partner[down, col] == under
        x, y, turns = b[lo, col], b[hi, col], np.arange(1, 4)[:, None, None]
        left, right = np.where(site == lo, x ^ turns, x), np.where(site == hi, y ^ turns, y)
        change = lambda there, a, c: np.where(there, self.stacks[a] - self.stacks[c], 0)
        outside, inside = (b[up, col], b[over, col]), (b[down, col], b[under, col])
        more = change(outer, self.at(*outside, left, right), self.at(*outside, x, y)) + change(inner, self.at(left, right, *inside), self.at(x, y, *inside))
        return np.where(partner < 0, 0.0, np.where(self.can[left, right], more, np.inf))


SCHEMA = "code long, structure string, mfe double, energy_gap double, ddg_gap array<double>, d_mfe array<double>"


def effects(codes: np.ndarray, length: int, least_gap: float = -1.0) -> pa.RecordBatch:
    """SCHEMA of those codes that fold with a gap over least_gap."""
    fold = Fold(codes, length)
    low, second = fold.lowest
    kept = (low % fold.unit > 0) & (second < FAR // 2) & (fold.energy(second) - fold.energy(low) > least_gap * 100)
    fold.only(kept)
    low, second = fold.lowest
    mfe, n = fold.energy(low), int(kept.sum())
    gap = fold.energy(second) - mfe
    symbols, partner = fold.partners(low)
    new, next_ = fold.mutants()
    new_low, held = fold.energy(new), mfe + fold.held(partner)
    new_gap = np.where(next_ < FAR // 2, fold.energy(next_) - new_low, np.inf)
    same, fits = new - new_low * fold.unit == low - mfe * fold.unit, np.isfinite(held)
    ddg = np.where(same, new_gap - gap, np.where(fits, new_low - held - gap, -np.inf))
    d_mfe = np.where(same, new_low, held) - mfe
    names = np.ascontiguousarray(np.frombuffer(b"().", "uint8")[symbols.T]).view(f"S{length}").ravel().astype(str)
    lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype="int32") * 3 * length, np.round(x.transpose(2, 1, 0).ravel() / 100, 2)) for x in (ddg, d_mfe)]
    columns = [pa.array(codes[kept]), pa.array(names.tolist(), pa.string()), pa.array(mfe / 100), pa.array(gap / 100), *lists]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def mutant_effects(seqs: DataFrame, length: int, least_gap: float = -1.0, together: int = 256) -> DataFrame:
    """code, structure, mfe, energy_gap, ddg_gap and d_mfe of the sequences among seqs (code) that fold with a gap over least_gap.

    Effects are arrays of 3 * length, those of `folding.sequence_effects`: number 3 * pos + turn - 1 is
    the mutant whose base at pos is the sequence's xor turn (1 to 3). Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(codes), together):
                yield effects(codes[at : at + together], length, least_gap)

    return seqs.select("code").mapInArrow(run, SCHEMA)
