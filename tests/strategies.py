"""Generators of valid and nearly valid records, for property tests."""

from hypothesis import strategies as st

bases = st.text("ACGTN", min_size=1, max_size=60)
iupac = st.text("ACGTURYSWKMBDHVNacgturyswkmbdhvn-.", max_size=60)
residues = st.text("ACDEFGHIKLMNPQRSTVWYX*", max_size=60)
header = st.text(st.characters(codec="utf-8", exclude_characters="\r\n", exclude_categories=("Cs", "Cc", "Zl", "Zp")), min_size=1, max_size=20)
graphic = st.characters(min_codepoint=33, max_codepoint=126)


@st.composite
def fastq(draw):
    """(header, sequence, quality)."""
    sequence = draw(bases)
    return draw(header), sequence, draw(st.text(graphic, min_size=len(sequence), max_size=len(sequence)))


@st.composite
def fasta(draw):
    return draw(header), draw(bases)


@st.composite
def ciglets(draw, ops="MIDNSHP=X", most=8):
    """(increment, operation), no two neighbours alike."""
    out = []
    for n, op in draw(st.lists(st.tuples(st.integers(1, 40), st.sampled_from(ops)), max_size=most)):
        if not out or out[-1][1] != op:
            out.append((n, op))
    return out


@st.composite
def aligned(draw):
    """(reference, query, cigar): a path over all of both."""
    path = draw(ciglets("MID"))
    n, m = (sum(k for k, op in path if op in ops) for ops in ("MD", "MI"))
    letters = st.text("ACGT", min_size=max(n, m), max_size=max(n, m))
    return draw(letters)[:n], draw(letters)[:m], "".join(f"{k}{op}" for k, op in path)


@st.composite
def sam(draw):
    """The fields of a record and its optional fields."""
    sequence = draw(bases)
    fields = [draw(st.text("abcXYZ019:_", min_size=1, max_size=9)), str(draw(st.integers(0, 65535))), draw(st.sampled_from(["chr1", "chr2", "*"])), str(draw(st.integers(0, 10**6))), str(draw(st.integers(0, 255))), f"{len(sequence)}M", "*", "0", "0", sequence, draw(st.text(graphic, min_size=len(sequence), max_size=len(sequence)))]
    tags = draw(st.lists(st.sampled_from(["AS:i:-5", "NM:Z:a b", "XA:A:!", "XF:f:1.5", "XH:H:0AFF", "XB:B:c,1,-2"]), max_size=3, unique=True))
    return fields, tags
