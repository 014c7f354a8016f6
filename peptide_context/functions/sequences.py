"""Column expressions on protein and DNA sequences.

They stay inside generated code, but for two passes over whole batches in numpy: residue counts and k-mer vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AMINO_ACIDS, FLANK, HYDROPATHY


def revcomp(seq: Column) -> Column:
    """Reverse complement; case and N are kept, other letters too."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def gene_symbol(title: Column) -> Column:
    """The first white-space token of a title that starts with GN=, without that; "." if none has it."""
    hay = F.concat(F.lit(" "), F.coalesce(title, F.lit("")))
    return F.when(F.regexp_like(hay, F.lit(r"\sGN=")), F.regexp_extract(hay, r"\sGN=(\S*)", 1)).otherwise(F.lit("."))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def fraction(seq: Column, letters: str) -> Column:
    """Share of ``letters`` in ``seq``; 0 for an empty sequence."""
    return F.when(F.length(seq) > 0, count_of(seq, letters) / F.length(seq)).otherwise(F.lit(0.0))


def slices(seqs: pa.Array, most: int = 2 << 20) -> Iterator[pa.Array]:
    """A batch of texts in parts of at most ``most`` bytes, or one text; nulls as empty texts."""
    seqs = pc.fill_null(seqs, "")
    ends = np.cumsum(pc.binary_length(seqs).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(seqs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield seqs.slice(at, to - at)
        at = to


def residue_counts(seq: Column) -> Column:
    """Array of how often each of the 20 residues occurs in ``seq``, in one pass; zeros for null."""
    place = np.full(256, len(AMINO_ACIDS), np.int64)
    place[np.frombuffer(AMINO_ACIDS.encode(), np.uint8)] = np.arange(len(AMINO_ACIDS))

    @F.arrow_udf("array<int>")
    def count(seqs: pa.Array) -> pa.Array:
        width = len(AMINO_ACIDS) + 1
        found = [np.empty(0, np.int32)]
        for part in slices(seqs):
            data = np.frombuffer("".join(part.to_pylist()).encode(), np.uint8)
            which = np.repeat(np.arange(len(part)), pc.binary_length(part).to_numpy(zero_copy_only=False))
            table = np.bincount(which * width + place[data], minlength=len(part) * width).reshape(len(part), width)
            found.append(table[:, :-1].astype(np.int32).ravel())
        flat = np.concatenate(found)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width - 1), pa.int32()), pa.array(flat))

    return count(seq)


def kmer_vector(seq: Column, dim: int, k: int) -> Column:
    """Array of ``dim`` doubles: k-mers counted by the MD5 digest of each as a number modulo ``dim``, over the root of the
    sum of squares; zeros for null and for texts shorter than k. A digest is made once for each k-mer of a batch."""

    @F.arrow_udf("array<double>")
    def embed(seqs: pa.Array) -> pa.Array:
        bucket: dict[str, int] = {}
        found = [np.empty(0)]
        for part in slices(seqs):
            text = "".join(part.to_pylist())
            size = pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            which = np.repeat(np.arange(len(part)), size)
            last = np.repeat(np.cumsum(size), size)
            at = np.flatnonzero(np.arange(len(text)) + k <= last)
            letter, key = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
            full = key[: max(0, len(key) - k + 1)].astype(np.int64)
            for j in range(1, k):
                full = full * len(letter) + key[j : len(key) - k + 1 + j]
                if full.size and int(full.max()) > 1 << 20:
                    full = np.unique(full, return_inverse=True)[1]
            full = full[at]
            place = np.full(int(full.max()) + 1 if len(full) else 0, -1, np.int64)
            place[full] = at
            used = np.flatnonzero(place >= 0)
            grams = [text[i : i + k] for i in place[used].tolist()]
            for g in grams:
                if g not in bucket:
                    bucket[g] = int(hashlib.md5(g.encode()).hexdigest(), 16) % dim
            place[used] = [bucket[g] for g in grams]
            counts = np.bincount(which[at] * dim + place[full], minlength=len(part) * dim).reshape(len(part), dim)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True).astype(np.float64))
            found.append((counts / np.where(norm > 0, norm, 1.0)).ravel())
        flat = np.concatenate(found)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))

    return embed(seq)


def dibasic_hint(seq: Column, mature_start: Column, motifs: tuple[str, ...] = ("KR", "RR", "RK", "KK")) -> Column:
    """The two residues just upstream of the mature start if they are a listed motif, else "."."""
    begin = F.greatest(mature_start - 2, F.lit(1))
    up = F.substring(seq, begin, F.greatest(mature_start - begin, F.lit(0)))
    return F.when(up.isin(*motifs), up).otherwise(F.lit("."))


def site_window(seq: Column, bond: Column, flank: int = FLANK) -> Column:
    """``left|right`` residues around the bond behind residue ``bond``, cut off at the ends."""
    begin = F.greatest(bond - flank, F.lit(0))
    return F.concat(F.substring(seq, begin + 1, bond - begin), F.lit("|"), F.substring(seq, bond + 1, F.lit(flank)))


def full_window(seq: Column, bond: Column, flank: int = FLANK) -> Column:
    """The 2 * flank residues around a bond; null where they run off an end."""
    inside = (bond >= flank) & (bond + flank <= F.length(seq))
    return F.when(inside, F.substring(seq, bond - flank + 1, F.lit(2 * flank)))


def _of(counts: Column, letters: str) -> Column:
    return sum((counts[AMINO_ACIDS.index(a)] for a in letters), F.lit(0))


def seq_stats(seq: Column, prefix: str, counts: Column | None = None) -> list[Column]:
    """Nine statistics of an upper-cased sequence; all 0 for a null or empty one. ``counts``: its residue counts, if a
    column has them already."""
    s = F.upper(F.coalesce(seq, F.lit("")))
    counts = residue_counts(s) if counts is None else counts
    n = F.length(s)
    share = lambda letters: F.when(n > 0, _of(counts, letters) / n).otherwise(F.lit(0.0))
    total = F.lit(0.0)
    for aa in AMINO_ACIDS:
        total = total + _of(counts, aa) * F.lit(HYDROPATHY[aa])
    hyd = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    stats = {
        "len": n.cast("double"),
        "charge": share("KR") - share("DE"),
        "cationic": share("KR"),
        "acidic": share("DE"),
        "hydropathy": hyd,
        "aromatic": share("FWY"),
        "cys": share("C"),
        "gly": share("G"),
        "boman": F.when(n > 0, -hyd).otherwise(F.lit(0.0)),
    }
    return [c.alias(f"{prefix}_{k}") for k, c in stats.items()]


def aa_composition(seq: Column, prefix: str, counts: Column | None = None) -> list[Column]:
    """Fraction of each of the 20 residues in an upper-cased sequence."""
    s = F.upper(F.coalesce(seq, F.lit("")))
    counts = residue_counts(s) if counts is None else counts
    n = F.greatest(F.length(s), F.lit(1))
    return [(_of(counts, a) / n).alias(f"{prefix}_aa_{a}") for a in AMINO_ACIDS]


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)); goes to 0 and 1 without overflow; null for null."""
    return F.when(x.isNotNull(), 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0)))))


def seeded_rank_key(*parts: Column) -> Column:
    """MD5 of parts joined by a bar: a draw that is the same on any partitioning and in other engines."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def kmers(seq: Column, k: int) -> Column:
    """Array of the overlapping k-mers of a sequence of letters, empty if it is shorter: one pass of a pattern that looks
    ahead at each place, however long the sequence."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
