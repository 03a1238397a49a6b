"""Command line: ``python -m windrow <run> --input <folder> --output <folder> [options]``.

Input tables are read by name (``<folder>/<table>.parquet`` or ``.csv``) and
result tables are written as parquet under the output folder.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.functions.times import with_time_columns
from windrow.operators.climate import normalize_climate
from windrow.operators.stats import missing_counts, source_summary, token_counts, zone_stats
from windrow.plans import cleaning, context, heatmap, measuring, preparation, twin
from windrow.plans.measuring import MeasureSettings
from windrow.settings import EventSettings, ModelSettings, MobilityWeights, ResilienceSettings, WindowSettings
from windrow.sources.recordings import RecordingTable
from windrow.sources.sinks import copy_tables, write_model, write_report, write_table, write_text, write_timeline
from windrow.sources.tables import mapping_table, path_exists, read_mapping, read_table


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="windrow", description=__doc__.splitlines()[0])
    parser.add_argument("run", choices=["measure", "clean", "prepare", "heatmap", "twin", "context", "semantic"])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", help="JSON or YAML file with settings by section")
    parser.add_argument("--stage", choices=sorted(preparation.STAGES), default="all")
    parser.add_argument("--dry-run", action="store_true", help="plan everything, write nothing")
    parser.add_argument("--max-windows", type=int)
    parser.add_argument("--max-media", type=int)
    parser.add_argument("--media", action="append", default=[], help="folder of recordings for measure; may be given several times")
    parser.add_argument("--force", action="store_true", help="measure recordings again whose results are still valid")
    parser.add_argument("--refresh", action="store_true", help="twin: measure more windows when too few are there for a model")
    parser.add_argument("--handoff", help="prepare: folder for a second copy of the tables")
    parser.add_argument("--csv", action="store_true", help="write CSV as well")
    return parser.parse_args(argv)


def load_settings(path: str | None) -> dict:
    """Sections ``windowing, events, resilience, model, mobility, measure`` over the defaults; unknown names are an error."""
    raw = {}
    if path:
        text = open(path, encoding="utf-8").read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(text) or {}
        else:
            raw = json.loads(text)
    base = {
        "windowing": WindowSettings(), "events": EventSettings(), "resilience": ResilienceSettings(), "model": ModelSettings(), "mobility": MobilityWeights(), "measure": MeasureSettings(),
    }
    out = {}
    for section, value in base.items():
        known = {f.name for f in fields(value)}
        given = raw.get(section, {})
        unknown = set(given) - known
        if unknown:
            raise ValueError(f"unknown settings in {section}: {sorted(unknown)}")
        out[section] = replace(value, **given)
    out["timezone"] = raw.get("timezone", "UTC")
    return out


class Folder:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, name: str) -> bool:
        return any(path_exists(self.spark, f"{self.path}/{name}.{k}") for k in ("parquet", "csv"))

    def raw(self, name: str) -> DataFrame:
        parquet = f"{self.path}/{name}.parquet"
        if path_exists(self.spark, parquet):
            return self.spark.read.parquet(parquet)
        return self.spark.read.option("header", True).csv(f"{self.path}/{name}.csv")

    def table(self, name: str) -> DataFrame:
        kind = "parquet" if path_exists(self.spark, f"{self.path}/{name}.parquet") else "csv"
        return read_table(self.spark, name, f"{self.path}/{name}.{kind}", kind)

    def maybe(self, name: str) -> DataFrame | None:
        return self.raw(name) if self.has(name) else None


class Refreshed(Folder):
    """A folder of which some tables were made anew."""

    def __init__(self, folder: Folder, tables: dict[str, DataFrame]):
        super().__init__(folder.spark, folder.path)
        self.tables = tables

    def raw(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else super().raw(name)


def climate_of(folder: Folder) -> DataFrame | None:
    if folder.has("env_daily"):
        return folder.table("env_daily")
    return normalize_climate(folder.raw("climate_sheet")) if folder.has("climate_sheet") else None


class Store:
    """Writes each finished table once and hands back the written table; in a dry run it hands back the plan."""

    def __init__(self, spark: SparkSession, folder: str, csv: bool, dry: bool):
        self.spark, self.folder, self.csv, self.dry = spark, folder.rstrip("/"), csv, dry
        self.done: set[str] = set()
        self.header = {"metadata": {"title": "window twin timeline"}}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        if self.dry or name in self.done:
            return df
        self.done.add(name)
        if name == "timeline":
            write_timeline(df, self.header, f"{self.folder}/timeline")
            return df
        write_table(df, f"{self.folder}/{name}", csv=self.csv)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def run_measure(folder: Folder, args, settings, store: Store) -> dict[str, DataFrame]:
    """New and changed recordings only; results of others are kept. Zones and sizes come from ``zone_configs.json`` and ``video_sizes``."""
    spark, wanted = folder.spark, settings["measure"]
    media = measuring.listed(spark, args.media or [folder.path])
    if args.dry_run:
        return {"files": media}
    media = store("files", media)
    out = {"files": media}
    sound = RecordingTable(spark, f"{args.output}/audio_frames_by_recording")
    count = measuring.measure_audio(sound, media, wanted, args.force)
    print(f"sound: {count} recordings measured")
    if (rows := sound.rows()) is not None:
        out["audio_frames"] = rows.filter("issue IS NULL").drop("issue", "fingerprint")
    if folder.has("video_sizes") and path_exists(spark, f"{folder.path}/zone_configs.json"):
        configs = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder.path}/zone_configs.json").collect()))
        sized = media.join(folder.raw("video_sizes").select("media_id", F.col("width").cast("int"), F.col("height").cast("int")), "media_id")
        changes = RecordingTable(spark, f"{args.output}/interval_metrics_by_recording")
        count = measuring.measure_video(changes, sized, configs, wanted, args.force)
        print(f"frames: {count} recordings measured")
        if (rows := changes.rows()) is not None:
            out["interval_metrics"] = rows.filter("issue IS NULL").drop("issue", "fingerprint")
    return out


def run_clean(folder: Folder, args, settings, store: Store) -> dict[str, DataFrame]:
    mapping = f"{folder.path}/path_mapping.csv"
    rules = read_mapping(folder.spark, mapping) if path_exists(folder.spark, mapping) else None
    return cleaning.clean_recordings(folder.raw("files"), rules, settings["timezone"], settings["windowing"], store)


def run_prepare(folder: Folder, args, settings, store: Store) -> dict[str, DataFrame]:
    steps = preparation.STAGES[args.stage]
    out: dict[str, DataFrame] = {}
    if "index" in steps:
        files = folder.raw("files")
        if args.max_media is not None:
            files = files.orderBy(F.lower("relative_path"), "media_id").limit(args.max_media)
        out |= preparation.index_recordings(files, settings["windowing"], {"total": args.max_windows}, store)
    manifest, windows = out.get("media_manifest"), out.get("video_window_index")
    climate = climate_of(folder) if "env" in steps else None
    if args.stage == "zones":
        out["zone_configuration"] = preparation.zone_configuration(folder.raw("zone_areas"), folder.maybe("rooms"))
    elif steps & {"video", "audio"}:
        out |= preparation.prepare(
            manifest, windows, folder.maybe("interval_metrics") if "video" in steps else None, folder.maybe("zone_areas") if "zones" in steps else None,
            folder.maybe("audio_frames") if "audio" in steps else None, climate, settings["windowing"], store=store, steps=steps,
        )
    elif climate is not None:
        out["env_daily"] = climate
    return out


def run_heatmap(folder: Folder, args, settings, store: Store) -> dict[str, DataFrame]:
    selected = store("selected_windows", heatmap.select(folder.raw("video_window_index"), k=args.max_windows, skip_bad=True))
    features = heatmap.measure(selected, folder.raw("media_manifest"), folder.raw("interval_metrics"), folder.raw("sample_times"), folder.raw("zones"), settings["windowing"])
    features = store("video_zone_features", features)
    frames, store.header = heatmap.timeline(features, folder.raw("zones"))
    return {"selected_windows": selected, "video_zone_features": features, "timeline": frames}


def refreshed(folder: Folder, settings, store: Store) -> Folder:
    """The folder to read features from: when they are too few for a model and the index holds more, all windows are measured first."""
    coverage = source_summary(folder.raw("video_zone_features"), folder.raw("video_window_index"))
    if not twin.needs_more_windows(coverage, settings["model"].min_windows):
        return folder
    again = Store(folder.spark, f"{store.folder}/refreshed", False, False)
    inputs = argparse.Namespace(max_windows=None)
    tables = run_heatmap(folder, inputs, settings, again)
    return Refreshed(folder, {n: tables[n] for n in ("selected_windows", "video_zone_features")})


def run_twin(folder: Folder, args, settings, store: Store) -> dict[str, DataFrame]:
    if args.refresh and not args.dry_run:
        folder = refreshed(folder, settings, store)
    zones, sources = twin.canonical_zones(folder.raw("video_zone_features"), folder.raw("selected_windows"), folder.raw("video_window_index"), folder.raw("media_manifest"))
    exports: dict = {}
    tables = twin.run(zones, folder.maybe("event_log"), {"total": args.max_windows}, settings["events"], settings["resilience"], settings["model"], settings["mobility"], exports=exports, layout=folder.maybe("zones"))
    store.header = exports["header"]
    if not args.dry_run:
        write_model(folder.spark, exports["model"], f"{store.folder}/model")
    return tables | {"schema_mapping": mapping_table(folder.spark, sources)}


def run_context(folder: Folder, args, settings, store: Store) -> dict[str, DataFrame]:
    biomarkers = with_time_columns(folder.raw("biomarker_window_table"))
    events = twin.event_frame(folder.raw("event_log"))
    plan = context.run_semantic if args.run == "semantic" else context.run
    return plan(biomarkers, folder.raw("audio_window_features"), climate_of(folder), events, settings["events"], settings["model"])


RUNS = {"measure": run_measure, "clean": run_clean, "prepare": run_prepare, "heatmap": run_heatmap, "twin": run_twin, "context": run_context, "semantic": run_context}


# The tables of the hand-off copy.
HANDOFF = (
    "media_manifest", "video_window_index", "semantic_zone_video_features", "semantic_biomarker_window_table", "audio_window_features", "env_daily",
    "processed_multimodal_window_table",
)

#: The order of listed windows.
BY_TIME = ["room_id", "session_id", "start_time", "window_id", "zone_id"]


def write_reports(args, tables: dict[str, DataFrame], store: Store) -> None:
    """Report of the run: figures as tables, and a listing of the first rows of its main table."""
    path = f"{store.folder}/report"
    listed = lambda name: {name: (tables[name], BY_TIME)}
    if args.run == "clean":
        write_report(path, "Recording clean-up", **cleaning.summarise(tables))
    elif args.run == "measure":
        write_report(path, "Measured recordings", {"files": (tables["files"], ["relative_path"])}, **{f"{n}_rows": f.groupBy("media_id").count() for n, f in tables.items() if n != "files"})
    elif "processed_multimodal_window_table" in tables:
        write_report(path, "Hand-off", listed("processed_multimodal_window_table"), **preparation.summarise(tables))
    elif args.run == "heatmap":
        features = tables["video_zone_features"]
        write_report(path, "Zone activity", listed("selected_windows"), zones=zone_stats(features, "activity_mean"), warnings=token_counts(features, "warnings"), missing=missing_counts(features))
    elif args.run == "twin":
        write_report(path, "Window twin", listed("hmm_state_sequence"), states=tables["hmm_state_summary"], events=tables["resilience_event_table"], phases=tables["event_validation_summary"], mapping=tables["schema_mapping"])
    elif args.run == "context":
        write_report(path, "Sound and climate context", listed("multimodal_window_table"), correlations=tables["audio_env_correlation_table"], phases=tables["event_multimodal_summary"], models=tables["hmm_ablation_metrics"])
    elif args.run == "semantic":
        write_report(path, "Semantic zones", listed("semantic_multimodal_window_table"), states=tables["semantic_hmm_state_summary"], models=tables["semantic_hmm_ablation_metrics"], phases=tables["semantic_event_validation_summary"])
    if args.run == "prepare" and args.handoff:
        copy_tables({n: tables[n] for n in HANDOFF if n in tables}, args.handoff.rstrip("/"))
        notes = ["# Hand-off", "", *[f"- {n}.csv" for n in HANDOFF if n in tables], "", "Recordings are not copied. Start from video_window_index and processed_multimodal_window_table."]
        write_text(store.spark, "\n".join(notes), f"{args.handoff.rstrip('/')}/readme")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    args = parse(argv)
    spark = spark or SparkSession.builder.appName(f"windrow {args.run}").getOrCreate()
    settings = load_settings(args.config)
    folder = Folder(spark, args.input)
    store = Store(spark, args.output, args.csv, args.dry_run)
    tables = RUNS[args.run](folder, args, settings, store)
    if args.dry_run:
        for name, df in tables.items():
            print(name, ", ".join(df.columns))
        return tables
    written = {n: store(n, df) for n, df in tables.items()}
    write_reports(args, written, store)
    return written


if __name__ == "__main__":
    main(sys.argv[1:])
