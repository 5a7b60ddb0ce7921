"""Explicit schemas of the engine's tables."""

FILE = "source_file string, full_text string"
CHUNK = "chunk_id string, source_file string, source_stem string, page_num int, chunk_index_on_page int, char_start int, char_end int, chunk_type string, text string"
SPANS = "array<struct<text:string,label:string,start:int,end:int>>"
SCORED_SPANS = "array<struct<text:string,label:string,start:int,end:int,score:double>>"
PREDICTION = f"id string, source_file string, page_num int, chunk_id string, text string, predicted_entities {SCORED_SPANS}"
ENTITY_INDEX = "chunk_id string, source_file string, page_num int, entity_labels array<string>, entity_texts array<string>"
ANNOTATED = f"id string, source_file string, page_num int, chunk_id string, text string, entities {SPANS}, auto_score int"
QUESTION = "id string, question_id string, question string, discipline string, source_doc_hint string"
QRELS = "id string, question_id string, relevant_chunk_ids array<string>, relevant_chunks array<string>, chunk_ids array<string>"
VECTOR = "chunk_id string, embedding array<float>"
