"""Command line over a stored library: `python -m shutterlake.cli COMMAND --library FOLDER`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import schema
from .engine import Engine, from_querystring
from .library import Library
from .operators import bursts, people, stats
from .sources import export, files
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("index", "demo", "cluster", "prune", "delete", "albums", "dedup", "stats", "search", "trips", "export-labels"))
    p.add_argument("--library", required=True, help="the store's folder")
    p.add_argument("--path", help="files to index, or the folder for sidecars")
    p.add_argument("--filters", default="", help="a saved search's query string")
    p.add_argument("--text", default="", help="a natural-language question")
    p.add_argument("--ids", default="", help="photo ids, with commas between")
    p.add_argument("--eps", type=float, default=schema.Settings.cluster_eps)
    p.add_argument("--min", type=int, default=schema.Settings.cluster_min)
    p.add_argument("--count", type=int, default=24)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("shutterlake").getOrCreate()
    store = Store(spark, a.library)
    library = Library(spark, store)
    c = library.catalog
    if a.command == "index":
        print(f"{library.index(a.path)} new files")
    elif a.command == "demo":
        store.commit({"photos": schema.reconcile(files.demo(spark, a.count), schema.PHOTO_DDL, {"named_face_count": 0})})
        print(f"{a.count} photos")
    elif a.command == "cluster":
        library.cluster(a.eps, a.min).show()
    elif a.command == "prune":
        done = library.prune(a.path)
        print(f"{done['removed']} removed, {done['kept']} kept")
    elif a.command == "delete":
        print(library.delete([int(x) for x in a.ids.split(",") if x]))
    elif a.command == "albums":
        library.searches().show(100, truncate=False)
    elif a.command == "dedup":
        bursts.redundant(bursts.bursts(c.photos)).show()
    elif a.command == "stats":
        stats.library_stats(c.photos, c.faces, c.persons).show(100, truncate=False)
    elif a.command == "search":
        page = Engine(c).ask(a.text, from_querystring(a.filters)).rows if a.text else Engine(c).photos(from_querystring(a.filters))[0]
        page.show(60, truncate=False)
    elif a.command == "trips":
        Engine(c).trips().show(60, truncate=False)
    else:
        print(f"{export.write_sidecars(export.sidecars(people.names_by_path(c.photos, c.faces, c.persons), a.path))} sidecars")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
