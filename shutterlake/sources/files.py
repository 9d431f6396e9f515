"""Files of a library as rows: listing with skip reasons, tab-separated gazetteers, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.paths import extension, file_name, is_junk, kind

MAX_DEPTH = 32


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size_bytes, modified_at) of all files below ``root``; their content is not read."""
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    return f.withColumn("rel_path", F.substr(plain, F.lit(len(base) + 1) if not base.startswith("file:") else F.lit(len(base.split(":", 1)[1].replace("//", "/")) + 1)))


def classify(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``files`` with ``skip``: why a file is no photograph (hidden, junk, empty, too deep, not a photo), or null."""
    p = F.col("rel_path")
    hidden = F.exists(F.split(p, "/"), lambda s: s.startswith("."))
    return files.withColumn(
        "skip",
        F.when(is_junk(p), "junk").when(hidden, "hidden").when(F.size(F.split(p, "/")) > max_depth, "too deep").when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty").when(kind(extension(p)).isin("other", "sidecar"), "not a photo"),
    )


def skip_counts(files: DataFrame) -> DataFrame:
    return classify(files).where("skip is not null").groupBy("skip").agg(F.count(F.lit(1)).alias("n"))


# The columns of a gazetteer of cities that are used, by place.
_CITY = {"place_id": (0, "bigint"), "name": (1, "string"), "lat": (4, "double"), "lon": (5, "double"), "country": (8, "string"), "population": (14, "bigint")}


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Cities of a tab-separated gazetteer: ``#`` lines and rows without a name or a valid position drop out, a bad population is 0."""
    parts = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cols = {n: F.get(parts, F.lit(i)).try_cast(t) for n, (i, t) in _CITY.items()}
    good = (F.col("name") != "") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return raw.select(*[c.alias(n) for n, c in cols.items()]).where(good).withColumn("population", F.coalesce("population", F.lit(0)))


def _attribute(xml: Column, name: str) -> Column:
    path = f"//@*[local-name()='{name}'] | //*[local-name()='{name}' and not(*)]"
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit(""))


_SAFE = r"(?s)^\s*<.*>\s*$"


def parse_sidecars(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``df`` with rating, color_label, author, city, country and keywords of a sidecar text; texts that are no XML give nulls."""
    text = F.when(F.col(xml).rlike(_SAFE) & ~F.col(xml).contains("<!DOCTYPE"), F.col(xml))
    rating = _attribute(text, "Rating").try_cast("int")
    words = F.xpath(text, F.lit("//*[local-name()='subject']//*[local-name()='li']/text()"))
    return df.withColumns(
        {
            "rating": F.when(rating.between(0, 5), rating),
            "color_label": F.when(F.lower(_attribute(text, "Label")).isin("red", "yellow", "green", "cyan", "blue", "purple"), F.lower(_attribute(text, "Label"))),
            "author": F.nullif(F.trim(F.xpath_string(text, F.lit("//*[local-name()='creator']//*[local-name()='li']"))), F.lit("")),
            "city": _attribute(text, "City"),
            "country": _attribute(text, "Country"),
            "keywords": words,
        }
    )


def compose_sidecar(rating: Column, label: Column, city: Column, country: Column, keywords: Column) -> Column:
    """A sidecar text in one fixed form; null fields are left out."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attr = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f' {n}="'), esc(c.cast("string")), F.lit('"'))).otherwise("")
    items = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("<rdf:li>"), esc(k), F.lit("</rdf:li>"))), "")
    bag = F.when(F.size(keywords) > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject>"))).otherwise("")
    head = (
        '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description'
        ' xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    )
    return F.concat(F.lit(head), attr("xmp:Rating", rating), attr("xmp:Label", F.initcap(label)), attr("photoshop:City", city), attr("photoshop:Country", country), F.lit(">"), bag, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def adopt_sidecars(assets: DataFrame, sidecars: DataFrame, columns: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Fill ``columns`` of assets from their sidecar, only where all of them are still untouched (null, blank or 0) and the asset is not among ``touched`` (asset_id: those with edits, issues or tags)."""
    s = sidecars.groupBy(F.col("asset_id").alias("__a")).agg(F.min(F.struct(*columns)).alias("__s"))
    untouched = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    pristine = F.col("__a").isNotNull()
    for c in columns:
        pristine = pristine & untouched(c)
    j = assets.join(s, F.col("id") == F.col("__a"), "left")
    if touched is not None:
        j = j.join(touched.select(F.col("asset_id").alias("__t")).where("__t is not null").distinct(), F.col("id") == F.col("__t"), "left")
        pristine = pristine & F.col("__t").isNull()
    return j.withColumn("__pristine", pristine).withColumns({c: F.when(F.col("__pristine"), F.coalesce(F.col(f"__s.{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}).select(assets.columns)


EXPORT_MODES = {"overwrite": "overwrite", "append": "append", "skip": "ignore"}


def export_table(df: DataFrame, path: str, policy: str) -> None:
    """Write rows under a policy for what exists: overwrite, append or skip."""
    df.write.mode(EXPORT_MODES[policy]).parquet(path)
