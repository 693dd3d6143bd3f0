"""Command line: `python -m lensaudit audit|html|pets`."""

from __future__ import annotations

import argparse
import importlib
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import AuditConfig, Measure
from ..functions import kernels, models
from ..report.markdown import html_page
from ..sources import decoders
from ..sources.records import pets_manifest
from .audit import Outputs, run_audit


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lensaudit", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="audit an image folder or a CSV manifest")
    for flag in ("dataset-root", "csv-path", "path-root", "source-column"):
        a.add_argument(f"--{flag}")
    a.add_argument("--image-column", default="image_path")
    a.add_argument("--label-column", default="label")
    a.add_argument("--output-dir", default="outputs/default_run")
    a.add_argument("--max-images", type=int)
    a.add_argument("--batch-size", type=int, default=32)
    a.add_argument("--csv-folders", action="store_true", help="write each CSV table as a folder of parts")
    a.add_argument("--projection", choices=("tsne", "umap"), default="tsne")
    a.add_argument("--decoder", choices=("jvm", "pillow"), default="jvm")
    a.add_argument("--weights", help="an .npz file with the weights of a residual network, whose vectors take the place of the grid statistics")
    a.add_argument("--image-size", type=int, default=224, help="side of the images that the network sees")
    a.add_argument("--measure", action="append", default=[], metavar="MODULE:FUNCTION", help="a measure of your own, a function of an image's pixels; may be repeated")
    h = sub.add_parser("html", help="a Markdown report as one HTML page")
    h.add_argument("--input-md", required=True)
    h.add_argument("--output-html")
    t = sub.add_parser("pets", help="a manifest from a pets dataset's annotations")
    t.add_argument("--dataset-root", required=True)
    t.add_argument("--output-csv")
    return p


def own_measure(name: str) -> Measure:
    module, _, function = name.partition(":")
    return Measure(function, getattr(importlib.import_module(module), function))


def session() -> SparkSession:
    return SparkSession.builder.appName("lensaudit").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "html":
        source = Path(args.input_md)
        target = Path(args.output_html) if args.output_html else source.with_suffix(".html")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(html_page(source.read_text(encoding="utf-8")), encoding="utf-8")
    elif args.command == "pets":
        root = Path(args.dataset_root).expanduser().resolve()
        target = Path(args.output_csv) if args.output_csv else root / "pets_manifest.csv"
        spark = session()
        Outputs(spark, str(target.parent)).csv(target.name, pets_manifest(spark, str(root)))
    else:
        values = {k: v for k, v in vars(args).items() if k not in ("command", "decoder", "weights", "image_size", "measure")}
        config = AuditConfig(**values, measures=tuple(map(own_measure, args.measure)))
        embed, status = kernels.grid_embedding, "grid statistics, no model"
        if args.weights:
            embed, status = models.network(args.weights, args.image_size, args.batch_size), f"a residual network, weights of `{args.weights}`"
        run_audit(session(), config, embed, status, decoders.pillow() if args.decoder == "pillow" else None)
