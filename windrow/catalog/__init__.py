"""Registered queries over the supplied tables, each with an independent SQL statement where SQL can say it."""

from windrow.catalog.registry import ORACLES, QUERIES  # noqa: F401


def load() -> None:
    """Import every query module so that the registry is filled."""
    from windrow.catalog import q_audio_climate, q_biomarkers, q_events, q_media, q_models, q_recordings, q_sequences, q_tables, q_windows  # noqa: F401
