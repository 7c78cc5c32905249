"""Schemas and closed vocabularies of the tables."""

from __future__ import annotations

#: Entity kinds, and each relation with the kinds of its ends; "Paper" is the paper at hand.
ENTITY_TYPES = ("Method", "Dataset", "Metric", "Task", "ProblemScenario")
RELATION_ENDS: dict[str, tuple[str, str]] = {
    "USES": ("Paper", "Method"),
    "TARGETS": ("Paper", "Task"),
    "ADDRESSES": ("Paper", "ProblemScenario"),
    "EVALUATED_ON": ("Method", "Dataset"),
    "APPLIES_TO": ("Method", "ProblemScenario"),
    "INVOLVES": ("ProblemScenario", "Task"),
}

FILES = "filename string, content binary, text string, md5 string, text_md5 string"
#: Size and time of change are null where a listing doesn't tell them.
MANIFEST = "filename string, md5 string, chunk_count int, length bigint, modified timestamp"
CHUNKS = "chunk_id string, filename string, index int, title string, headers map<string,string>, text string"
VECTORS = "chunk_id string, embedding array<float>"
ABBREVIATIONS = "norm_key string, full_name string"
ENTITY = "struct<name:string,type:string>"
RELATION = "struct<head:string,relation:string,tail:string>"
PERFORMANCE = "struct<method:string,metric:string,value:string,condition:string,dataset:string>"
#: What a model returns for one chunk.
EXTRACTION = f"entities array<{ENTITY}>, relations array<{RELATION}>, performances array<{PERFORMANCE}>"
#: What is kept for one paper.
EXTRACTIONS = (
    "filename string, content_hash string, title string, schema_version int, "
    f"entities array<struct<type:string,name:string>>, relations array<{RELATION}>, "
    "performances array<struct<chunk_index:int,method:string,metric:string,value:string,condition:string,dataset:string>>, "
    "mentions array<struct<chunk_index:int,type:string,name:string>>, "
    "n_mentions int, n_performances int"
)
EDGES = "src_label string, src_key string, rel_type string, dst_label string, dst_key string"
