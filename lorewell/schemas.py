"""Schemas of the tables that the operators read and write."""

CHUNK = (
    "id string, doc_id string, kb_ids array<string>, content string, content_vector array<double>, doc_name string, important_keywords array<string>, "
    "question_keywords array<string>, img_id string, page_num_int array<int>, create_timestamp_flt double, available_int int, score double"
)
ENTITY = "name string, type string, description string, embedding array<double>, source_id array<string>"
RELATION = "src_id string, dst_id string, type string, description string, weight double, source_id array<string>"
GRAPH_DOC = (
    "id string, kb_id string, graph_type string, entity_name string, src_name string, dst_name string, description string, weight double, "
    "source_ids array<string>, embedding array<double>, content_with_weight string, updated_at string"
)
INDEX_MESSAGE = "user_id string, tenant_id string, knowledge_base_id string, document_id string, local_message_id string"
GRAPH_MESSAGE = (
    "document_id string, knowledge_base_id string, tenant_id string, llm_id string, entity_types array<string>, "
    "enable_entity_resolution boolean, enable_community boolean, local_message_id string"
)
TASK = "id long, status string, retry_times int, max_retry_times int, next_retry_time timestamp, created_time timestamp, payload string"
