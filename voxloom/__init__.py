"""voxloom: Spark-first segmentation, pooling, clustering and scoring of one-dimensional signals."""

from importlib import import_module
from typing import Any

__version__ = "0.1.0"

#: Public name -> where it lives; modules are imported when a name is first used.
_WHERE = {
    "segment_audio": "api.segment_audio",
    "run_evaluation": "api.run_evaluation",
    "evaluate_segmentation": "api.evaluate_segmentation",
    "embed_audio": "api.embed_corpus",
    "embed_corpus": "api.embed_corpus",
    "embed_corpus_to_storage": "api.embed_corpus_to_storage",
    "discover_corpus": "api.discover_corpus",
    "segment_and_embed_audio": "api.segment_and_embed",
    "segment_embed_and_discover": "api.segment_embed_and_discover",
    "EmbeddingPipeline": "api.EmbeddingPipeline",
    "get_amplitude_envelope": "operators.segmentation.envelope_of",
    "list_segmenters": "operators.segmentation.list_segmenters",
    "list_segmenter_aliases": "operators.segmentation.list_segmenter_aliases",
    "list_presets": "presets.list_presets",
    "get_preset": "presets.get_preset",
    "resolve_preset": "presets.resolve_preset",
    "attach_textgrid_labels_to_manifest": "operators.labels.attach_labels",
    "compute_discovery_label_metrics": "operators.contingency.score",
    "export_discovery_label_artifacts": "sources.stores.export_label_artifacts",
    "load_discovery_label_artifacts": "sources.stores.load_label_artifacts",
    "build_file_manifest": "operators.manifests.file_manifest",
    "build_segmentation_manifest": "operators.manifests.segment_manifest",
    "build_discovery_manifest": "operators.manifests.discovery_manifest",
    "build_label_manifest": "operators.manifests.label_manifest",
    "join_corpus_manifests": "operators.manifests.join_corpus",
    "load_manifest": "operators.manifests.load",
    "flatten_results": "operators.evaluation.flatten",
    "aggregate_results": "operators.evaluation.aggregate",
    "plot_segmentation_result": "plotting.plot_segmentation_result",
    "save_embeddings": "sources.stores.save_embeddings",
    "load_embeddings": "sources.stores.load_embeddings",
    "save_archives": "sources.stores.save_archives",
    "load_archives": "sources.stores.load_archives",
    "DiscoveryPipeline": "operators.discovery.DiscoveryPipeline",
    "save_discovery_pipeline": "operators.discovery.save_pipeline",
    "load_discovery_pipeline": "operators.discovery.DiscoveryPipeline.load",
}
__all__ = ["__version__", *_WHERE]


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(name)
    module, *rest = _WHERE[name].split(".")
    path = [module]
    while rest:
        try:
            import_module(f"{__name__}.{'.'.join([*path, rest[0]])}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{'.'.join([*path, rest[0]])}":
                raise
            break
        path.append(rest.pop(0))
    found: Any = import_module(f"{__name__}.{'.'.join(path)}")
    for part in rest:
        found = getattr(found, part)
    return found
