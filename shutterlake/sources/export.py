"""Sidecars with the names of the persons in each photo, and copies of originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import xml_escape

_HEAD = (
    '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    '<rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/">'
)
_TAIL = "</rdf:Description></rdf:RDF></x:xmpmeta>"


def _bag(tag: str, items: Column) -> Column:
    return F.concat(F.lit(f"<{tag}><rdf:Bag>"), F.array_join(F.transform(items, lambda n: F.concat(F.lit("<rdf:li>"), n, F.lit("</rdf:li>"))), ""), F.lit(f"</rdf:Bag></{tag}>"))


def xmp(names: Column) -> Column:
    """A sidecar document: the names as subjects, and below People."""
    safe = F.transform(names, xml_escape)
    below = F.transform(safe, lambda n: F.concat(F.lit("People|"), n))
    return F.concat(F.lit(_HEAD), _bag("dc:subject", safe), _bag("lr:hierarchicalSubject", below), F.lit(_TAIL))


def sidecars(named: DataFrame, dest: str | None = None) -> DataFrame:
    """target, document for each photo (path, names): next to it, or in a folder."""
    base = F.regexp_extract("path", r"\A(.*?)(\.[^./]*)?\z", 1)
    to = base if dest is None else F.concat(F.lit(dest.rstrip("/") + "/"), F.element_at(F.split(base, "/"), -1))
    return named.select(F.concat(to, F.lit(".xmp")).alias("target"), xmp(F.col("names")).alias("document"))


def write_sidecars(docs: DataFrame) -> int:
    """Each document to its target, from the executors, through Python's file system; how many."""

    def put(rows) -> None:
        import os

        for r in rows:
            os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
            part = r["target"] + ".part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r["document"])
            os.replace(part, r["target"])

    docs.foreachPartition(put)
    return docs.count()


def copy_files(plan: DataFrame) -> dict[str, int]:
    """Carry out an export plan (id, path, target): requested, copied, missing."""
    import shutil

    def put(rows) -> None:
        import os

        for r in rows:
            if r["path"] and os.path.exists(r["path"]):
                os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
                shutil.copy2(r["path"], r["target"])

    plan.foreachPartition(put)
    asked = plan.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    @F.udf("boolean")
    def there(p: str | None) -> bool:
        import os

        return bool(p) and os.path.exists(p)

    copied = plan.filter(there("path") & there("target")).count()
    return {"requested": asked, "copied": copied, "missing": asked - copied}


def delete_files(paths: DataFrame) -> int:
    """Unlink the files (path) from the executors; how many were there."""

    @F.udf("boolean")
    def gone(p: str | None) -> bool:
        import os

        try:
            os.unlink(p or "")
        except OSError:
            return False
        return True

    return paths.select(gone("path").alias("g")).filter("g").count()
