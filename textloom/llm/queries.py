"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing
from textloom.llm.bagminhash import op4_minhash_near_dedup
from textloom.llm.fingerprints import op5_iblt_fingerprints
from textloom.llm.licences import op9_licence_scan
from textloom.llm.linkgraph import op6_link_graph
from textloom.llm.mixing import op8_poisson_mixing
from textloom.llm.ogg import op10_media_ogg
from textloom.llm.packing import op7_hilbert_packing
from textloom.llm.pseudolikelihood import op1_pseudo_likelihood
from textloom.llm.quality import op2_quality_classifier
from textloom.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_iblt_fingerprints": op5_iblt_fingerprints,
    "op6_link_graph": op6_link_graph,
    "op7_hilbert_packing": op7_hilbert_packing,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_licence_scan": op9_licence_scan,
    "op10_media_ogg": op10_media_ogg,
}

ORACLE_SQL: dict[str, str] = {"op8_poisson_mixing": mixing.SQL}
