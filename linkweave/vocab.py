"""Fixed, ordered vocabularies of the network model."""

# Gold-standard order and which of them carry a direction.
GOLD_STANDARDS = ["Complex", "Metabolic", "Operon", "PPI", "Regulatory", "Signaling"]
DIRECTED_GOLD_STANDARDS = ["Regulatory"]

# Evidence order, directed types, and types that travel over orthologs.
EVIDENCE_TYPES = ["DOM", "GIN", "GRG", "MEX", "MIR", "PEX", "PHP", "PIN", "SCL", "TFB"]
DIRECTED_EVIDENCE = ["GRG"]
ORTHOLOGY_TRANSFER = ["GIN", "GRG", "MEX", "MIR", "PEX", "PIN", "TFB"]
REDUNDANCY_WEIGHTED = ["MEX"]

# NCBI taxonomy ids of the modelled species, in output order.
SPECIES = [
    "3702", "224308", "9913", "6239", "9615", "7719", "7227", "44689", "7955", "83333", "9031",
    "9606", "243232", "10090", "83332", "39947", "36329", "10116", "559292", "284812", "9823", "273057",
]

# Direction codes of a link stored as A > B.
UNDIRECTED, A_TO_B, B_TO_A, BOTH_WAYS = 1, 2, 3, 5

# Training defaults.
REDUNDANCY_ALPHA = 0.7
REDUNDANCY_MIN_SIZE = 100
SAMPLE_RANGE = (100, 1_000_000)
MIN_R2 = 0.9
MIN_PPV = 0.85
ENRICHMENT_PPV = 0.95
BOOTSTRAPS = 30
GRID_POINTS = 1000
DEGREE_BIN = 150
