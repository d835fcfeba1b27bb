"""Types and constants of typed causal graphs.  Schemas are declared, never inferred."""

from __future__ import annotations

# The closed vocabularies, thresholds and weights of the data model.
ROLES = ("problem", "mechanism", "state", "outcome", "constraint", "method", "evidence", "resource", "agent")
TYPES = ("causes", "prevents", "requires", "part_of", "constrains", "supports", "contradicts")
ASSERTIONS = ("asserted", "negated")
MODALITIES = ("actual", "possible", "conditional")
PROVENANCE_KINDS = ("extracted", "manual")
CONCEPT_ID = r"^(wd|openalex|acmccs|local):[^\s:][^\s]*$"
SHA256 = r"^[0-9a-f]{64}$"
SOFT_ROLES = (
    ("state", "mechanism", 0.6), ("problem", "state", 0.5), ("outcome", "state", 0.5), ("mechanism", "method", 0.4),
    ("constraint", "problem", 0.3), ("evidence", "state", 0.3), ("resource", "state", 0.3), ("problem", "outcome", 0.3),
)
AFFINITY = {"role": 0.50, "label": 0.35, "knowledge": 0.15}
STRUCTURAL = {"role": 0.10, "containment": 0.15, "symmetric": 0.05, "relations": 0.45, "systematicity": 0.25, "contradiction": 0.30}
HARD_CONF, TWIN, TWIN_CHOSEN = 0.9, 0.8, 0.4
GATE_NODES, GATE_RELATIONS, REPEAT = 4.0, 3.0, 0.25
BUDGET, STOP_FRACTION, STOP_FROM = 96, 0.5, 20
FUSION = {"structural": 0.45, "concept": 0.40, "content": 0.15}
BM25_K1, BM25_B = 1.2, 0.75
OVERFETCH, LEAST_POOL = 4, 24
RANK_BLEND = {"structural": 0.65, "semantic": 0.35}
MODES = ("structural", "analogical", "complementary")
VERDICTS = ("direct", "approximate", "analogical", "complementary", "negative")
MOST_NODES, MOST_RELATIONS, MOST_CHARS = 64, 128, 20_000

SPAN = "struct<start:int,end:int,text:string>"
REF = "struct<id:string,conf:double,via:string>"
NODE = f"struct<id:string,label:string,role:string,spans:array<{SPAN}>,extract_conf:double,atomic:boolean,assertion:string,modality:string,knowledge:struct<about:array<{REF}>,requires:array<{REF}>>>"
RELATION = f"struct<id:string,source:string,target:string,type:string,extract_conf:double,spans:array<{SPAN}>,cue:{SPAN},assertion:string,modality:string,provenance_refs:array<string>>"
GRAPH = f"thought_id string, schema_version string, source struct<text:string,sha256:string>, provenance struct<kind:string,extractor:struct<id:string,version:string>,human_id:string>, nodes array<{NODE}>, relations array<{RELATION}>"
SCHEMA_VERSION = "thought-dna/0.1"
SESSION = (
    "schema_version string, session_id string, person struct<person_id:string,display_label:string,avatar_placeholder:string>, "
    "consent struct<share_enabled:boolean,share_thought_dna:boolean,share_coarse_location:boolean,share_display_profile:boolean>, "
    "location struct<kind:string,region:string,city:string,lat:double,lon:double,precision:string>, presentation struct<domain:string,topic:string,cluster_id:string>, "
    f"record_provenance struct<record_kind:string,builder_id:string,notes:string>, thought_dna struct<{GRAPH.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>"
)
