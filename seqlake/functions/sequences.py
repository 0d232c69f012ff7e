"""Column functions on sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How letters of ordinary text stand for bases, and the suffixes of sequence files.
TEXT_LETTERS = "abcdefghijklmnopqrstuvwxyz\n"
TEXT_BASES = "ACGTACGTACGTACGTACGTACGTACN"
FILE_SUFFIXES = (".zstd", ".zst", ".gzip", ".gz", ".xz", ".bz2", ".bz", ".bzip2", ".fasta", ".fastq", ".fna", ".fa", ".fq", ".fas")


def dna_of_text(text: Column) -> Column:
    """Letters as bases, line ends as breaks; everything else is dropped."""
    lines, bases = TEXT_LETTERS + TEXT_LETTERS[:-1].upper(), TEXT_BASES + TEXT_BASES[:-1]
    other = "".join(c for c in map(chr, range(256)) if c not in lines)  # without a counterpart, so dropped
    # one character for each byte: those of other characters are all over 127; a pattern takes six times as long
    return F.translate(F.decode(text.cast("binary"), "ISO-8859-1"), lines + other, bases)


def reverse_complement(seq: Column) -> Column:
    """In upper case; what is no base stays."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def homopolymer_compress(seq: Column) -> Column:
    """Runs of one base become a single one; other characters stay breaks."""
    out = F.upper(seq)
    for base in "ACGT":
        out = F.regexp_replace(out, f"{base}+", base)
    return out


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def dataset_name(path: Column) -> Column:
    """The file name without its suffixes, each taken off once in a fixed order; ``color`` if nothing is left."""
    name = F.element_at(F.split(path, "/"), -1)
    for suffix in FILE_SUFFIXES:
        name = F.regexp_replace(name, suffix.replace(".", "\\.") + "$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("color"))
