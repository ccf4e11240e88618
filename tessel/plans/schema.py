"""Schemas of the data model, as DDL."""

TRIPLES = "head_type string, head string, relation string, tail_type string, tail string"
EDGES = "edge_id string, src_id string, dst_id string, edge_type string, src_type string, dst_type string, attrs_json string"
NODES = "node_id string, node_type string, degree_out long, degree_in long, community_id int, attrs_json string"
RAW_NODES = "node_id string, node_type string, raw_id string, attrs_json string"
ADJACENCY = "node_id string, node_type string, cluster_id string, degree_out long, degree_in long, attrs_json string, physical_row_id long, out_neighbor_row_ids array<long>, in_neighbor_row_ids array<long>"
RESULTS = "engine string, query_type string, seed string, k int, batch_size int, time_ms double, result_count int, success boolean, error_message string"
DOCUMENTS = "id string, title string, content string, category string, publish_year int, author_id string, image_url string"
AUTHORS = "id string, name string, department string"
