"""Command line: trains a forest on text matrices and saves it.

    python -m thicket -c counts.tsv -ifh names.txt -o model -t 100 -depth 4 -leaves 20 -ss 300 -ifs 50 -ofs 50

``-c`` gives one matrix, judged on itself (unsupervised); ``-ic`` and ``-oc`` give
inputs and outputs.  Headers: ``-ifh``, ``-ofh``, or ``-h`` for both.  All other
flags are those of ``Parameters.of``; flags without a value are switches.
"""

from __future__ import annotations

from .operators.trainer import Parameters

#: Flags that name files, and what they mean.
FILES = {
    "c": "counts", "counts": "counts",
    "ic": "input", "input_counts": "input", "input": "input",
    "oc": "output", "output_counts": "output", "output": "output",
    "ifh": "input_header", "ih": "input_header",
    "ofh": "output_header", "oh": "output_header",
    "h": "header", "header": "header",
    "s": "samples", "samples": "samples",
    "o": "save", "output_location": "save",
}


def parse(argv: list[str]) -> tuple[dict[str, str], dict[str, object]]:
    """(files, options)."""
    files: dict[str, str] = {}
    options: dict[str, object] = {}
    at = 0
    while at < len(argv):
        flag = argv[at]
        if not flag.startswith("-"):
            raise SystemExit(f"a flag is expected where {flag!r} stands")
        name, value = flag.lstrip("-"), True
        following = argv[at + 1] if at + 1 < len(argv) else "-"
        if not following.startswith("-") or following[1:2].isdigit():
            value, at = following, at + 1
        if name in FILES:
            files[FILES[name]] = str(value)
        else:
            options[name] = value
        at += 1
    if "counts" in files:
        files["input"] = files["counts"]
        options.setdefault("unsupervised", True)
    Parameters.of(**options)
    return files, options


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .model import fit
    from .sources.text import read_header, read_matrix

    files, options = parse(argv)
    if "input" not in files:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName("thicket").getOrCreate()
    header = files.get("output_header") or files.get("header") or (files.get("input_header") if "output" not in files else None)
    names = [r.name for r in read_header(spark, header).orderBy("feature_id").collect()] if header else None
    outputs = read_matrix(spark, files["output"]) if "output" in files else None
    forest = fit(spark, read_matrix(spark, files["input"]), outputs, header=names, **options)
    if "samples" in files:
        forest.set_sample_names(read_header(spark, files["samples"]).select(F.col("feature_id").cast("long").alias("sample_id"), "name"))
    forest.save(files.get("save", "./forest"))
