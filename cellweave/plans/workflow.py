"""A workflow file (INI) to a plan: strict about its sections and keys."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

#: Sections that a workflow may have.
SECTIONS = ("paths_info", "paths_to_segment", "initialization", "workflow", "measurements", "standard_postprocess_features", "segmentation_model_params", "tracker_params")
TRUE, FALSE = ("true", "yes", "1", "on"), ("false", "no", "0", "off")
TYPES = ("segmentation and/or tracking", "measurements")


class WorkflowError(ValueError):
    """A workflow that cannot be run."""


def flag(text: str) -> bool:
    t = text.strip().lower()
    if t not in TRUE + FALSE:
        raise WorkflowError(f"neither yes nor no: {text!r}")
    return t in TRUE


def optional(text: str | None) -> str | None:
    """A value, or None where it says so."""
    return None if text is None or text.strip().lower() in ("", "none") else text.strip()


def vector(text: str) -> list[float]:
    """Numbers between commas or spaces, brackets or not."""
    return [float(x) for x in text.strip("()[] \n").replace(",", " ").split()]


def spread(values: list[int], n: int) -> list[int]:
    """One value for every path, or one each."""
    if len(values) == 1:
        return values * n
    if len(values) != n:
        raise WorkflowError(f"{len(values)} stop frames for {n} paths")
    return values


@dataclass
class Workflow:
    """What a workflow asks for."""

    kind: str
    paths: list[str]
    stop_frames: list[int]
    channels: list[str]
    segm: str = ""
    save: list[str] | None = None
    skip: list[str] = field(default_factory=list)
    steps: list[tuple[str, dict]] = field(default_factory=list)
    min_area: int = 0
    min_solidity: float = 0.0
    max_elongation: float = float("inf")
    track: bool = False
    threshold: float = 0.4
    denominator: str = "area_prev"


def _list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").replace("\n", ",").split(",") if x.strip()]


def _steps(section: configparser.SectionProxy) -> list[tuple[str, dict]]:
    out = []
    for key in sorted((k for k in section if k.startswith("preprocess_step_")), key=lambda k: int(k.rsplit("_", 1)[1])):
        name, _, options = section[key].partition(":")
        values = dict(x.split("=", 1) for x in options.split(";") if "=" in x)
        numbers = {k.strip(): (lambda v: v if len(v) > 1 or k.strip() == "sigmas" else v[0])(vector(v)) for k, v in values.items()}
        out.append((name.strip(), {k: int(v) if k in ("radius", "block") else v for k, v in numbers.items()}))
    return out


def parse(text: str) -> Workflow:
    """The workflow of a file's text; unknown sections and missing keys are errors."""
    ini = configparser.ConfigParser(interpolation=None, strict=True)
    try:
        ini.read_string(text)
    except configparser.Error as e:
        raise WorkflowError(str(e)) from e
    unknown = [s for s in ini.sections() if s not in SECTIONS and not s.startswith("preprocess.")]
    if unknown:
        raise WorkflowError(f"no such section: {unknown[0]}")
    get = lambda s, k, d=None: optional(ini[s].get(k)) or d if s in ini else d
    kind = get("workflow", "type", TYPES[1])
    if kind not in TYPES:
        raise WorkflowError(f"no such workflow: {kind}")
    paths = _list(get("paths_info", "paths")) or _list(get("paths_to_segment", "paths"))
    if not paths:
        raise WorkflowError("no path is given")
    stops = [int(x) for x in _list(get("paths_info", "stop_frame_numbers", "-1"))]
    denominator = get("tracker_params", "overlap_denominator", "area_prev")
    if denominator not in ("area_prev", "union"):
        raise WorkflowError(f"no such denominator: {denominator}")
    post = "standard_postprocess_features"
    return Workflow(
        kind=kind, paths=paths, stop_frames=spread(stops, len(paths)), channels=_list(get("measurements", "channels")) or _list(get("initialization", "channels")),
        segm=get("initialization", "segm_endname", ""), save=_list(get("measurements", "metrics")) or None, skip=_list(get("measurements", "metrics_to_skip")),
        steps=_steps(ini["segmentation_model_params"]) if "segmentation_model_params" in ini else [], min_area=int(float(get(post, "min_area", "0"))),
        min_solidity=float(get(post, "min_solidity", "0")), max_elongation=float(get(post, "max_elongation", "inf")), track=flag(get("workflow", "do_tracking", "no")),
        threshold=float(get("tracker_params", "ioa_threshold", "0.4")), denominator=denominator,
    )


def _up_to_stops(workflow: Workflow, pixels, stops):
    """Pixels before their position's stop frame; a position that is not among the workflow's paths is an error."""
    from pyspark.sql import functions as F

    if stops is None:
        stop = workflow.stop_frames[0]
        return pixels if stop < 0 else pixels.where(F.col("frame_i") < stop)
    unknown = F.raise_error(F.concat(F.lit("no path of the workflow: "), F.col("position").cast("string")))
    known = pixels.join(stops, "position", "left").withColumn("__stop", F.when(F.col("__stop").isNull(), unknown).otherwise(F.col("__stop")))
    return known.where("__stop < 0 or frame_i < __stop").drop("__stop")


def _stops(workflow: Workflow, pixels):
    """``(position, __stop)`` of every path, where pixels tell positions apart."""
    if "position" not in pixels.columns:
        return None
    return pixels.sparkSession.createDataFrame(list(dict(zip(workflow.paths, workflow.stop_frames)).items()), "position string, __stop long")


def run_segmentation(workflow: Workflow, pixels, segmenter, roi=None, projection: str | None = None, z: int | None = None):
    """The label image ``(…, frame_i, y, x, label)`` of a segmentation workflow: each position's pixels up to its stop frame, flattened,
    by the workflow's preprocessing, any ``segmenter`` (a function of a plane), its limits of shape, and tracked if it says so.
    """
    from pyspark.sql import functions as F

    from cellweave.operators import segment, tracking

    if workflow.kind != TYPES[0]:
        raise WorkflowError("the workflow does not segment")
    many = "position" in pixels.columns
    keys = ["position", "frame_i"] if many else ["frame_i"]
    used = _up_to_stops(workflow, pixels, _stops(workflow, pixels))
    found = segment.run_position(used, segmenter, workflow.steps, projection, z, roi, workflow.min_area, workflow.min_solidity, workflow.max_elongation, keys=keys)
    if not workflow.track:
        return found.select(*keys, "y", "x", "label")
    own = found if many else found.withColumn("position", F.lit(workflow.paths[0]))
    return tracking.track(own, ["position"], workflow.threshold, workflow.denominator).select(*keys, "y", "x", "label")


def run_measurements(workflow: Workflow, channels: dict, n_frames: int, **options):
    """The object table of a workflow's channels (dense pixels with labels), tracked first if it says so.

    Pixels of several positions carry a ``position``, the path it is from: each position is tracked and measured for
    itself, up to the stop frame of its path, which is its last frame; one that is not among the paths is an error. Pixels without
    one are of the workflow's first path. ``options`` go to ``objects.measure``.
    """
    from pyspark.sql import functions as F

    from cellweave.operators import objects, tracking

    lacking = [c for c in workflow.channels if c not in channels]
    if lacking:
        raise WorkflowError(f"no such channel: {lacking[0]}")
    used = {c: channels[c] for c in workflow.channels or channels}
    first = next(iter(used.values()))
    many = "position" in first.columns
    stops = _stops(workflow, first)
    used = {c: _up_to_stops(workflow, p, stops) for c, p in used.items()}
    keys = ["position"] if many else []
    if workflow.track:
        first = next(iter(used.values()))
        own = first if many else first.withColumn("position", F.lit(workflow.paths[0]))
        tracked = tracking.track(own, ["position"], workflow.threshold, workflow.denominator).withColumnRenamed("label", "__tracked")
        tracked = tracked if many else tracked.drop("position")
        used = {c: p.join(tracked, [*keys, "frame_i", "y", "x"], "left").withColumn("label", F.coalesce("__tracked", F.lit(0))).drop("__tracked") for c, p in used.items()}
    if many:
        ends = F.when(F.col("__stop") < 0, F.lit(n_frames)).otherwise(F.least(F.col("__stop"), F.lit(n_frames)))
        frames = stops.select("position", ends.alias("n_frames"))
    else:
        frames = n_frames if workflow.stop_frames[0] < 0 else min(n_frames, workflow.stop_frames[0])
    return objects.measure(used, frames, keys=keys, save=workflow.save, skip=workflow.skip, **options)
