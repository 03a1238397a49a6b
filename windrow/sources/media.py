"""Media files: listing, probing, sidecars, workbooks."""

from __future__ import annotations

import io
import json
import shutil
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.functions.text import path_key, room_id_from_path
from windrow.operators.climate import SHEET_COLUMNS
from windrow.operators.ordered import range_position


def scan_media(spark: SparkSession, root: str, pattern: str = "*.[mM][pP]4") -> DataFrame:
    """Files below a folder: path, size, modification time. The content is never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    prefix = root.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:/+", "/")
    return listing.select(
        path.alias("file_path"),
        F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path).alias("relative_path"),
        F.col("length").alias("file_size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_time"),
    )


def union_scans(*scans: DataFrame) -> DataFrame:
    """Union of several listings without repeated files."""
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out.dropDuplicates(["file_path"])


def with_media_ids(files: DataFrame, prefix: str = "media", positional: bool = False) -> DataFrame:
    """Media ids: a digest of the path, or (``positional``) numbers in path order.

    Numbers change for all later files when a file is added; digests do not.
    """
    if not positional:
        return files.withColumn("media_id", F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(path_key("relative_path"), 256), 1, 12)))
    keyed = files.withColumn("_key", path_key("relative_path"))
    placed = range_position(keyed, [F.col("_key"), F.col("file_path")], "_n")
    return placed.withColumn("media_id", F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("_n").cast("string"), 6, "0"))).drop("_key", "_n")


def with_rooms(files: DataFrame) -> DataFrame:
    return files.withColumn("room_id", room_id_from_path("relative_path"))


def require_tool(name: str) -> str:
    """Path of an external program, or an error that names it."""
    found = shutil.which(name)
    if found is None:
        raise FileNotFoundError(f"{name} was not found on the path")
    return found


def probe_files(files: DataFrame, command: list[str], output: str, issue: str) -> DataFrame:
    """Run an external program once per file inside tasks and keep its JSON text.

    The program must be present on the executors. A failure, an empty answer or
    unreadable JSON gives ``{}`` and the issue token; the run goes on.
    """
    def run(batches):
        for pdf in batches:
            texts, issues = [], []
            for path in pdf["file_path"]:
                text, note = "{}", None
                try:
                    done = subprocess.run([*command, path], capture_output=True, text=True, check=False)
                    if done.returncode == 0 and done.stdout.strip():
                        json.loads(done.stdout)
                        text = done.stdout
                    else:
                        note = issue
                except (OSError, ValueError):
                    note = issue
                texts.append(text)
                issues.append(note)
            yield pd.DataFrame({"file_path": pdf["file_path"], output: texts, f"{output}_issue": issues})

    probed = files.select("file_path").mapInPandas(run, f"file_path string, {output} string, {output}_issue string")
    return files.join(probed, "file_path", "left")


# How the two metadata programs are called.
FFPROBE = ["ffprobe", "-v", "error", "-show_streams", "-show_format", "-print_format", "json"]
EXIFTOOL = ["exiftool", "-j", "-api", "QuickTimeUTC=1"]


# How recordings are decoded, mono sound and grey frames as raw bytes on standard output.
FFMPEG_AUDIO = "ffmpeg -v error -i {path} -vn -ac 1 -ar {rate} -f s16le -"
FFMPEG_FRAMES = "ffmpeg -v error -i {path} -an -vf fps=1/{period},scale={width}:{height} -pix_fmt gray -f rawvideo -"


def _stream(command: str, size: int, **values):
    """Standard output of a program in pieces of ``size`` bytes, the last one shorter; never the whole of it."""
    words = [w.format(**values) for w in command.split()]
    with subprocess.Popen(words, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as process:
        while piece := process.stdout.read(size):
            yield piece
        if process.wait() != 0:
            raise OSError(f"{words[0]} failed")


def decode_audio(media: DataFrame, sample_rate: int, frame_seconds: float = 1.0, command: str = FFMPEG_AUDIO) -> DataFrame:
    """Sound as rows of one frame each (``media_id, chunk_start, pcm``, 16-bit samples); recordings that fail give one row with ``issue``."""
    step = max(1, round(sample_rate * frame_seconds))

    def run(batches):
        for pdf in batches:
            for media_id, path in zip(pdf["media_id"], pdf["file_path"]):
                start, issue = 0, "no_audio_samples"
                try:
                    for piece in _stream(command, 2 * step, path=path, rate=sample_rate):
                        if len(piece) < 2:
                            continue
                        issue = None
                        yield pd.DataFrame({"media_id": [media_id], "chunk_start": [start], "pcm": [piece[: len(piece) // 2 * 2]], "issue": [None]})
                        start += step
                except OSError:
                    issue = "ffmpeg_decode_failed"
                if issue:
                    yield pd.DataFrame({"media_id": [media_id], "chunk_start": [start], "pcm": [b""], "issue": [issue]})

    return media.select("media_id", "file_path").mapInPandas(run, "media_id string, chunk_start bigint, pcm binary, issue string")


def decode_frames(media: DataFrame, width: int, period: float = 2.0, command: str = FFMPEG_FRAMES) -> DataFrame:
    """Grey frames every ``period`` seconds as rows, scaled to ``width``; needs ``width`` and ``height`` in ``media``."""
    def run(batches):
        for pdf in batches:
            for media_id, room, path, w, h in zip(pdf["media_id"], pdf["room_id"], pdf["file_path"], pdf["width"], pdf["height"]):
                height, index = max(1, round(h * width / w)), 0
                try:
                    for piece in _stream(command, width * height, path=path, period=period, width=width, height=height):
                        if len(piece) == width * height:
                            yield pd.DataFrame({"media_id": [media_id], "room_id": [room], "frame_time_sec": [index * period], "height": [height], "width": [width], "pixels": [piece], "issue": [None]})
                        index += 1
                except OSError:
                    yield pd.DataFrame({"media_id": [media_id], "room_id": [room], "frame_time_sec": [index * period], "height": [height], "width": [width], "pixels": [b""], "issue": ["opencv_open_failed"]})

    ddl = "media_id string, room_id string, frame_time_sec double, height int, width int, pixels binary, issue string"
    room = F.col("room_id") if "room_id" in media.columns else F.lit(None)
    return media.select("media_id", room.cast("string").alias("room_id"), "file_path", "width", "height").mapInPandas(run, ddl)


def read_sidecars(spark: SparkSession, folder: str, output: str = "probe") -> DataFrame:
    """Saved metadata texts, one file per media id (``<media_id>.json``)."""
    raw = spark.read.option("wholetext", True).text(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.select(name.alias("media_id"), F.col("value").alias(output))


def stale_sidecars(sidecars: DataFrame, active: DataFrame) -> DataFrame:
    """Sidecars whose media id is no longer known."""
    return sidecars.join(active.select("media_id"), "media_id", "left_anti")


def prune_sidecars(spark: SparkSession, folder: str, active: DataFrame, dry_run: bool = False) -> int:
    """Delete the sidecars of recordings that are not ``active`` (``media_id``); returns how many there were.

    Names come to the driver one partition at a time.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("media_id"), "path")
    count = 0
    for row in stale_sidecars(names, active).select("path").toLocalIterator():
        count += 1
        if not dry_run:
            files.delete(hadoop(row["path"]), False)
    return count


def exif_tags(text) -> "F.Column":
    """Tag document (a list with one object) as a map of texts."""
    return F.coalesce(
        F.try_element_at(F.from_json(text, "array<map<string, string>>"), F.lit(1)), F.from_json(text, "map<string, string>"), F.create_map().cast("map<string, string>")
    )


def zone_image_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Room, plain image and marked image: ``x_reference.png`` with ``x_reference_with_notes.png``; the first pair per room."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path")
    marked = listing.filter(F.endswith("path", F.lit("_reference_with_notes.png"))).select(
        F.regexp_replace("path", "_with_notes", "").alias("plain"), F.col("path").alias("marked")
    )
    pairs = marked.join(listing.select(F.col("path").alias("plain")), "plain").withColumn("room_id", room_id_from_path("plain"))
    return pairs.groupBy("room_id").agg(F.min(F.struct("plain", "marked")).alias("p")).select("room_id", F.col("p.plain").alias("reference_image"), F.col("p.marked").alias("annotated_image"))


def read_workbooks(spark: SparkSession, pattern: str) -> DataFrame:
    """Climate workbooks, one per room, as texts with ``room_id`` and ``source_file``.

    Workbooks are spread over tasks, one file at a time, and need openpyxl there.
    """
    columns = list(SHEET_COLUMNS)
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    ddl = "path string, " + ", ".join(f"{c} string" for c in columns)

    def run(batches):
        try:
            import openpyxl  # noqa: F401
        except ImportError as error:  # pragma: no cover - depends on the cluster image
            raise RuntimeError("reading workbooks needs openpyxl on every executor") from error
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                sheet = pd.read_excel(io.BytesIO(content), dtype=str)
                absent = [c for c in columns if c not in sheet.columns]
                if absent:
                    raise ValueError("climate sheet lacks columns: " + ", ".join(absent))
                yield sheet[columns].assign(path=path)[["path", *columns]]

    sheets = files.mapInPandas(run, ddl)
    return sheets.withColumn("room_id", room_id_from_path("path")).withColumnRenamed("path", "source_file")
