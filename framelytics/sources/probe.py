"""Facts of media files from what a prober prints, and checks of names and arguments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import str2sec


def facts(probes: DataFrame) -> DataFrame:
    """(media_id, width, height, fps, duration, has_audio) from (media_id, text); null where the text doesn't say.

    The last video stream counts. Sides are swapped if the picture is turned by 90 degrees.
    """
    video = F.element_at(F.regexp_extract_all("text", F.lit(r"[^\n]*Video:[^\n]*"), F.lit(0)), -1)
    number = lambda pattern, k: F.nullif(F.regexp_extract(F.coalesce("video", F.lit("")), pattern, k), F.lit(""))
    found = probes.withColumn("video", F.when(F.col("text").contains("Video:"), video))
    turned = F.col("text").rlike(r"displaymatrix:[^\n]*?\b90\.\d+")
    a, b = (number(r"[ ,](\d+)x(\d+)[ ,]", k).cast("int") for k in (1, 2))
    time = F.nullif(F.regexp_extract("text", r"Duration: ([\d:.]+)", 1), F.lit(""))
    return found.select(
        "media_id", F.when(turned, b).otherwise(a).alias("width"), F.when(turned, a).otherwise(b).alias("height"),
        number(r"([\d.]+) fps", 1).cast("double").alias("fps"), F.when(time.isNotNull(), str2sec(time)).alias("duration"), F.col("text").contains("Audio:").alias("has_audio"),
    )


def frame_counts(containers: DataFrame, px: DataFrame) -> DataFrame:
    """(media_id, frames): what the container says (media_id, nb_frames), else as many frames as there are."""
    counted = px.groupBy("media_id").agg(F.countDistinct("frame_idx").alias("counted"))
    return containers.join(counted, "media_id", "full").select("media_id", F.coalesce(F.col("nb_frames").cast("long"), "counted").alias("frames"))


class WrongContainer(ValueError):
    """A file name's ending is not the one that is asked for."""


def extension(path: str) -> str:
    found = re.search(r"\.[^./\\]+$", path)
    return found.group().lower() if found else ""


def need_container(path: str, ending: str) -> None:
    if extension(path) != ending.lower():
        raise WrongContainer(f"{path} does not end in {ending}")


def need_same_container(a: str, b: str) -> None:
    if extension(a) != extension(b):
        raise WrongContainer(f"{a} and {b} end differently")


def free_name(wanted: str, taken: list[str]) -> str:
    """The wanted file name; if it is taken, with the least number over all that are taken of this name and ending."""
    if wanted not in taken:
        return wanted
    ending = extension(wanted)
    stem = wanted[: len(wanted) - len(ending)]
    numbers = [int(m.group(1)) for t in taken if (m := re.fullmatch(re.escape(stem) + r"_(\d+)" + re.escape(ending), t))]
    return f"{stem}_{max(numbers, default=-1) + 1}{ending}"


FILTERS, BLURS, CROPS = ("regular", "binary", "blob"), ("none", "average"), ("none", "manual", "auto")


def need_arguments(fps: float = 25, filtertype: str = "Regular", thresh: float = 0.05, starttime: float = 0, endtime: float = 0, blur: str = "None", skip: int = 0, frames: int = 0, crop: str = "None") -> None:
    """ValueError unless a clip can be opened with these."""
    rules = {
        "fps": fps > 0, "filtertype": filtertype.lower() in FILTERS, "thresh": 0 <= thresh <= 1, "starttime": starttime >= 0, "endtime": endtime >= 0,
        "blur": blur.lower() in BLURS, "skip": skip >= 0 and int(skip) == skip, "frames": frames >= -1 and int(frames) == frames, "crop": crop.lower() in CROPS,
    }
    bad = [name for name, fine in rules.items() if not fine]
    if bad:
        raise ValueError(f"out of range: {', '.join(bad)}")


#: Names of map projections, and those that mean the first.
EQUIRECT = ("equirect", "equirectangular", "erp", "e")
PROJECTIONS = (*EQUIRECT, "c3x2", "c6x1", "c1x6", "eac", "flat", "gnomonic", "rectilinear", "dfisheye", "barrel", "fb", "barrelsplit", "sg", "mercator", "ball", "hammer", "sinusoidal", "fisheye", "pannini", "cylindrical", "perspective", "tetrahedron", "tsp", "he", "hequirect", "equisolid", "og", "octahedron", "cylindricalea")


def projection(name):
    """A column of projection names by their usual one; null if there's no such projection."""
    low = F.lower(name)
    return F.when(low.isin(*EQUIRECT), EQUIRECT[0]).when(low.isin(*PROJECTIONS), low)
