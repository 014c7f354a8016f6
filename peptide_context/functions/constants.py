"""Alphabets, published scales and the curated rule tables the operators default to."""

#: The 20 standard residues.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

#: Kyte-Doolittle hydropathy.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

#: Residues on each side of a bond, and the names of their places.
FLANK = 4
POSITION_LABELS = ["P4", "P3", "P2", "P1", "P1'", "P2'", "P3'", "P4'"]

#: Fixed values: (family pattern, role, gene); ".*" rules are the defaults.
FAMILY_RULES = [
    ("cathelicidin|CAMP", "enzyme", "PRTN3"),
    ("cathelicidin|CAMP", "enzyme", "KLK5"),
    ("defensin|DEFA", "enzyme", "MMP7"),
    ("defensin|DEFB", "enzyme", "FURIN"),
    ("histatin|HTN|HRNR", "enzyme", "."),
    ("dermcidin|DCD", "enzyme", "CTSD"),
    (".*", "enzyme", "FURIN"),
    (".*", "transporter", "ABCA1"),
]

#: Fixed values: (enzyme, role, pattern, residues from match start to the bond, residues that a match takes).
PROTEASE_MOTIFS = [
    ("FURIN", "convertase", "R.[KR]R", 4, 4),
    ("FURIN_min", "convertase", "R..R", 4, 4),
    ("PCSK_dibasic", "convertase", "[KR][KR]", 2, 2),
    ("KLK5", "serine", "[KR](?=[^P])", 1, 1),
    ("KLK7", "serine", "[YFWL](?=[^P])", 1, 1),
    ("KLK14", "serine", "[KR](?=[^P])", 1, 1),
    ("PRTN3", "serine", "[AVSCT](?=[LIVF])", 1, 1),
    ("MMP7", "metallo", "[ASTGN](?=[LIVMFY])", 1, 1),
    ("CTSD", "aspartic", "[FLM](?=[FLYWM])", 1, 1),
]

#: Role weights when a mature start is chosen; other roles weigh 1.
ROLE_PRIORITY = {"convertase": 3.0, "serine": 1.5, "metallo": 1.0, "aspartic": 1.0}

#: Fixed values: (factor, IUPAC consensus).
TF_MOTIFS = [
    ("VDR_RXR_DR3", "AGGTCANNNAGGTCA"),
    ("NFKB_RELA", "GGGRNNYYCC"),
    ("CEBP", "TTGCGCAA"),
    ("AP1", "TGASTCA"),
    ("STAT_GAS", "TTCNNNGAA"),
    ("ISRE_IRF", "AGTTTCNNTTTC"),
    ("HNF4", "AGGTCAAAGGTCA"),
]

#: IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

#: Genomic-context fields that feature vectors take over as they are.
ENZYME_FIELDS = ["enzyme_present", "enzyme_dist_kb", "cut_score", "n_strong_cuts"]
LOCUS_FIELDS = ["locus_len_bp", "intron_frac", "gc_locus", "n_exons", "transporter_present", "gene_density", "neighbor_amp_count"]
