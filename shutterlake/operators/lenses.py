"""Lens names matched to profiles by maker, focal range, generation and aperture; never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell a maker, and words of a lens name that tell nothing about its family.
MAKER_WORDS = {"panasonic": "panasonic", "lumix": "panasonic", "olympus": "olympus", "zuiko": "olympus", "canon": "canon", "nikon": "nikon", "nikkor": "nikon", "sony": "sony", "sigma": "sigma", "tamron": "tamron", "fujifilm": "fujifilm", "fuji": "fujifilm", "pentax": "pentax", "tokina": "tokina", "samyang": "samyang", "leica": "leica"}
PLAIN_WORDS = ["panasonic", "olympus", "canon", "nikon", "sony", "leica", "lens", "vario"]

_NUMBER = r"(\d+(?:\.\d+)?)"
APERTURE = rf"(?i)(?<![a-z0-9])(?:f/?|1:)\s*{_NUMBER}(?:\s*[-–—−]\s*{_NUMBER})?"
ZOOM = rf"(?i)(?<![\d.]){_NUMBER}\s*(?:mm)?\s*[-–—−]\s*{_NUMBER}\s*mm"
PRIME = rf"(?i)(?<![\d.]){_NUMBER}\s*mm"


def maker(text: Column) -> Column:
    """The maker a text names, or null."""
    words = F.split(F.lower(text), "[^a-z]+")
    known = F.filter(words, lambda w: w.isin(list(MAKER_WORDS)))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MAKER_WORDS.items() for x in kv]), F.get(known, F.lit(0)))


def generation(name: Column) -> Column:
    """2 to 4 for a name marked II to IV, v2 to v4 or mark 2 to 4; else 1."""
    n = F.lower(name)
    mark = lambda roman, k: n.rlike(rf"(^|[^a-z0-9.])({roman}|v{k}|mk{k}|(mark|mk|version)[^a-z0-9.]+{k})([^a-z0-9.]|$)")
    joined = lambda roman: n.rlike(rf"\d{roman}([^a-z0-9.]|$)")
    return F.when(mark("iv", 4), 4).when(mark("iii", 3) | joined("iii"), 3).when(mark("ii", 2) | joined("ii"), 2).otherwise(1)


def features(name: Column) -> dict[str, Column]:
    """Focal range, widest apertures and generation of a lens name; nulls where it doesn't tell."""
    part = lambda p, g: F.regexp_extract(name, p, g).try_cast("double")
    zoom = F.regexp_extract(name, ZOOM, 0) != ""
    low = F.when(zoom, part(ZOOM, 1)).otherwise(part(PRIME, 1))
    wide = part(APERTURE, 1)
    return {"focal_min": low, "focal_max": F.when(zoom, part(ZOOM, 2)).otherwise(low), "wide": wide, "tele": F.coalesce(part(APERTURE, 2), wide), "generation": generation(name)}


def family_score(name: Column, profile: Column) -> Column:
    """Number of distinctive words of a lens name that its profile has too."""
    words = lambda c: F.split(F.lower(c), "[^a-z]+")
    own = F.filter(words(name), lambda w: (F.length(w) >= 4) & ~w.isin(PLAIN_WORDS))
    shared = F.size(F.filter(own, lambda w: F.array_contains(words(profile), w)))
    return shared + (F.contains(F.lower(name), F.lit("leica")) & F.contains(F.lower(profile), F.lit("leica"))).cast("int")


def match_lenses(inputs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(camera_make, camera_model, lens, profile) of each distinct input that one profile fits.

    ``profiles`` are (maker, model, mounts); a mount is what camera models say they have, here the models themselves. A profile fits if
    maker, focal range and generation are equal, and the aperture where the input tells one. Those for the camera's mount come first,
    then those that share most words, then by name; without an aperture a tie in words matches none. Inputs without a focal length match
    a profile of equal name. A maker no text names is the text itself. Inputs are reduced to distinct ones, so the join is of name lists.
    """
    i = inputs.where("trim(lens) <> ''").select("camera_make", "camera_model", F.trim("lens").alias("lens")).distinct()
    named = F.coalesce(maker(F.col("lens")), maker(F.col("camera_make")), F.lower("camera_make"))
    panasonic = (maker(F.col("camera_make")) == "panasonic") & (maker(F.col("lens")) == "leica")
    i = i.withColumn("by", F.when(F.coalesce(panasonic, F.lit(False)), "panasonic").otherwise(named)).withColumns(features(F.col("lens")))
    p = profiles.withColumn("p_maker", F.coalesce(maker(F.col("maker")), F.lower("maker"))).withColumns({f"p_{k}": c for k, c in features(F.col("model")).items()})
    same = (F.col("by") == F.col("p_maker")) & (F.col("focal_min") == F.col("p_focal_min")) & (F.col("focal_max") == F.col("p_focal_max")) & (F.col("generation") == F.col("p_generation"))
    aperture = F.col("wide").isNull() | ((F.col("wide") == F.col("p_wide")) & (F.col("tele") == F.col("p_tele")))
    whole = F.col("focal_min").isNull() & (F.col("by") == F.col("p_maker")) & (F.lower("lens") == F.lower("model"))
    fits = i.join(p, (F.col("by") == F.col("p_maker")) & ((same & aperture) | whole))
    rank = F.struct((~F.coalesce(F.array_contains("mounts", F.col("camera_model")), F.lit(False))).cast("int").alias("off"), (-family_score(F.col("lens"), F.col("model"))).alias("less"), F.col("model"))
    best = fits.groupBy("camera_make", "camera_model", "lens", "wide").agg(F.slice(F.array_sort(F.collect_set(rank)), 1, 2).alias("r"))
    tie = F.col("wide").isNull() & (F.size("r") > 1) & (F.get("r", F.lit(0))["off"] == F.get("r", F.lit(1))["off"]) & (F.get("r", F.lit(0))["less"] == F.get("r", F.lit(1))["less"])
    return best.where(~F.coalesce(tie, F.lit(False))).select("camera_make", "camera_model", "lens", F.get("r", F.lit(0))["model"].alias("profile"))
