"""Names, constants and table schemas."""

from __future__ import annotations

# The domain of entity types, node prefixes, and the weights of the retrieval model.
ENTITY_TYPES = ("Who", "What", "When", "Where", "Why", "How", "How much")
MEMORY_PREFIX, ENTITY_PREFIX = "memory:", "entity:"
ENTITY_WEIGHT, SEMANTIC_WEIGHT = 0.3, 0.7
MIN_REL_SCORE, TOP_K_PER_KEY = 0.5, 20
WHO_SCALE, NEIGHBOUR_SCALE = 0.25, 0.5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
KS = (5, 10, 25, 50)

DIALOG = "sample_id string, session_num int, date_time string, pos int, dia_id string, speaker string, text string, query string, img_url string, blip_caption string"
MEMORY = "sample_id string, memory_id string, dia_id string, session_num int, date_time string, speaker string, text string, text_normalized string, query string, img_url string, blip_caption string, metadata map<string,string>"
ENTITY = "sample_id string, entity_id string, key string, value string, type string, merged_from array<string>, metadata map<string,string>"
MENTION = "sample_id string, edge_id string, entity_id string, memory_id string, edge_type string, weight double, metadata map<string,string>"
MEMORY_EDGE = "sample_id string, edge_id string, src_memory_id string, dst_memory_id string, edge_type string, weight double, metadata map<string,string>"
QUESTION = "sample_id string, qa int, question string, answer string, evidence array<string>, category int"
ITEM = "array<struct<value:string,type:string>>"
