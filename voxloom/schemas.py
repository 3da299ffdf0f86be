"""Schemas of the tables that operators exchange, as DDL strings."""

FILE = "file_id long, audio_path string, file_stem string"
SPAN = "struct<start:double,peak:double,end:double>"
SEGMENT = "file_id long, segment_id long, start double, peak double, end double, segmentation_method string, segmentation_kwargs_ref string, num_segments int"
EMBEDDING_MANIFEST = "file_id long, audio_path string, embedding_path string, num_rows int, embedding_dim int, success boolean, error string, segmentation string, features string, pooling string, preset string"
EMBEDDING = "file_id long, segment_id long, embedding array<double>"
DISCOVERY = "file_id long, segment_id long, embedding_id long, start double, peak double, end double, cluster_label int, embedding_path string, discovery_method string, discovery_model_path string, discovery_kwargs_ref string"
LABEL = "tg_labels array<string>, tier_labels_concat string, primary_label string, primary_label_peak string, primary_label_max_overlap string, textgrid_path string, label_attached boolean, label_source string"
TIER = "path string, tier_idx int, tier_name string, interval_idx int, xmin double, xmax double, text string"
INTERVAL = "xmin double, xmax double, text string"
FRAME = "file_id long, frame int, t double, vec array<double>"
SIGNAL = "file_id long, idx int, t double, v double"
BUNDLE = "file_id long, audio_path string, embeddings array<array<double>>, metadata map<string,string>, success boolean, error string"
EVAL_COUNTS = "file_id string, eval_method string, TP long, Ins long, Del long, Sub long, TER double"
