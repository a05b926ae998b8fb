"""Graph contract: table schemas, id prefixes, endpoint types, axes and path weights."""
from __future__ import annotations

from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in ("node_id", "node_type", "label", "props")])
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in ("src", "dst", "edge_type", "props")])
EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("smiles_input", T.StringType()), T.StructField("ext_id_1", T.StringType()), T.StructField("ext_id_2", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("label", T.ByteType()),
        T.StructField("label_type", T.StringType()), T.StructField("split", T.StringType()), T.StructField("source_file", T.StringType()),
    ]
)

#: Node types of the canonical graph and their id prefixes.
NODE_PREFIXES = {
    "Example": "ex:", "Ligand": "lig:", "Scaffold": "sca:", "Protein": "protein:", "ProteinCluster": "ProteinCluster::",
    "DatasetSource": "src:", "Assay": "chembl_asy:", "Publication": "chembl_doc:", "DecoyProtocol": "proto:",
    "DecoyProtocolClass": "protoclass:", "Split": "split:", "LabelType": "lt:", "TimeBin": "time:", "TrainSet": "train:",
}

#: Edge type, source type, target type, path weight, axes.
EDGES = (
    ("example_has_ligand", "Example", "Ligand", 1.00, ("ligand", "scaffold")),
    ("ligand_exact", "Ligand", "Ligand", 1.00, ("ligand",)),
    ("ligand_parent_exact", "Ligand", "Ligand", 0.95, ("ligand",)),
    ("ligand_fingerprint_exact", "Ligand", "Ligand", 0.95, ("ligand",)),
    ("ligand_similar", "Ligand", "Ligand", 0.65, ("ligand",)),
    ("ligand_scaffold", "Ligand", "Scaffold", 0.70, ("scaffold",)),
    ("example_has_protein", "Example", "Protein", 1.00, ("protein",)),
    ("protein_exact", "Protein", "Protein", 1.00, ("protein",)),
    ("protein_cluster_30", "Protein", "ProteinCluster", 0.45, ("protein",)),
    ("protein_cluster_50", "Protein", "ProteinCluster", 0.65, ("protein",)),
    ("protein_cluster_90", "Protein", "ProteinCluster", 0.85, ("protein",)),
    ("example_from_assay", "Example", "Assay", 0.75, ("assay",)),
    ("example_from_publication", "Example", "Publication", 0.55, ("assay",)),
    ("example_from_source", "Example", "DatasetSource", 0.35, ("source",)),
    ("source_decoy_protocol", "Example", "DecoyProtocol", 0.50, ("source",)),
    ("decoy_protocol_in_class", "DecoyProtocol", "DecoyProtocolClass", 0.90, ("source",)),
    ("ligand_measured_protein", "Ligand", "Protein", 0.90, ()),
    ("example_in_split", "Example", "Split", 1.00, ()),
    ("example_has_label_type", "Example", "LabelType", 1.00, ()),
    ("example_has_timebin", None, None, 1.00, ("time",)),
    ("time_overlap", None, None, 0.40, ("time",)),
    ("example_in_trainset", None, None, 1.00, ()),
)
PAIR_EDGES = ("ligand_exact", "ligand_parent_exact", "ligand_fingerprint_exact", "ligand_similar", "protein_exact")
#: Corpus-level names of node and edge types, and what the canonical graph calls them.
NODE_MAP = {"ProteinTarget": "Protein"}
EDGE_MAP = {"example_has_protein_target": "example_has_protein", "same_inchikey_as": "ligand_exact", "same_parent_inchikey_as": "ligand_parent_exact", "ligand_has_scaffold": "ligand_scaffold"}
SIMILARITY_FLOOR, EXACT_FLOOR = 0.80, 0.9995
LABEL_TYPES = ("active", "inactive", "decoy", "random")


def endpoints() -> dict[str, tuple[str, str]]:
    """Endpoint types of the edge types that declare them."""
    return {e: (a, b) for e, a, b, _, _ in EDGES if a is not None}


def weights() -> dict[str, float]:
    return {e: w for e, _, _, w, _ in EDGES}


def axes() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for e, _, _, _, own in EDGES:
        for a in own:
            out[a] = (*out.get(a, ()), e)
    return out


def non_axis() -> tuple[str, ...]:
    return tuple(e for e, _, _, _, own in EDGES if not own)
