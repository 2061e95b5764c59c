"""``python -m plumbline.plans.cli config.json``: the comparisons of a configuration.

The configuration holds ``left`` and ``right`` (settings of a source), ``keys``, and optionally ``columns`` (name: rule),
``options``, ``filters`` (texts for both, left, right; a side's filters of a column replace the common ones of it; and
``sql``, an expression for each of both, left, right), ``mode`` (key, position, multiset) and ``out``; or ``pairs``, a list of such
blocks, each laid over the common ones; or ``folders`` (left, right, pattern, recursive), whose files of equal name are
pairs and whose other files count as differences.  A pair that fails doesn't stop the others.  Over several pairs the
summaries are also written together in the common ``out``."""

from __future__ import annotations

import json
import sys
from pathlib import PurePosixPath

from pyspark.sql import SparkSession, functions as F

from ..functions import predicates
from ..operators import match
from ..operators.diff import Options, Rule
from ..session import build
from ..sources.guard import redacted
from ..sources.load import Source, pair_folders
from .outputs import Counts, Result, exit_code, roll_up, write_table


def compare(spark: SparkSession, block: dict) -> Result | Counts:
    position = block.get("mode") == "position"
    sides = []
    for side in ("left", "right"):
        filters, df = block.get("filters", {}), Source.from_config(block[side]).load(spark, number=True)
        own = [predicates.parse(t) for t in filters.get(side, [])]
        both = [f for f in map(predicates.parse, filters.get("both", [])) if f.column not in {o.column for o in own}]
        formats = {c: r.get(f"{side}_formats") or r.get("formats", ()) for c, r in block.get("columns", {}).items()}
        df = df.filter(predicates.every(both, formats=formats)).filter(predicates.every(own, null_keeping=False, formats=formats))
        for which in ("both", side):
            if raw := filters.get("sql", {}).get(which):
                if ";" in raw:
                    raise ValueError("a filter can't hold ';'")
                df = df.filter(F.expr(raw))
        sides.append(df)
    if block.get("mode") == "multiset":
        both = [c for c in sides[0].columns if c in sides[1].columns and c != "__rn__"]
        return Counts(match.multiset(*sides, both))
    keys = ["__rn__"] if position else list(block["keys"])
    names = [[c for c in s.columns if c != "__rn__"] for s in sides]
    common = [c for c in names[0] if c in names[1] and c not in keys]
    apart = [tuple(c for c in own if c not in other) for own, other in (names, names[::-1])]
    options = Options(**block.get("options", {}), rules={c: Rule(**r) for c, r in block.get("columns", {}).items()})
    # duplicates pair in file order
    return Result(match.keyed(*sides, keys, ["__rn__"], "unique" if position else block.get("duplicates", "index")), keys, common, options, *apart, profiled=block.get("profile", False))


def files(spark: SparkSession, folder: str, recursive: bool) -> list[str]:
    """The paths of a folder's files, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, recursive), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def folder_pairs(spark: SparkSession, config: dict) -> tuple[list[dict], list[str]]:
    """A block for each pair of files, and the files without a counterpart."""
    f = config["folders"]
    pairs, left, right = pair_folders(*(files(spark, f[s], f.get("recursive", False)) for s in ("left", "right")), f.get("pattern", "*"))
    block = lambda a, b: {"left": config.get("left", {}) | {"path": a}, "right": config.get("right", {}) | {"path": b}} | ({"out": f"{config['out']}/{PurePosixPath(a).stem}"} if config.get("out") else {})
    return [block(a, b) for a, b in pairs], left + right


def run(spark: SparkSession, config: dict) -> int:
    shared, done, errors = {k: v for k, v in config.items() if k not in ("pairs", "folders")}, [], 0
    blocks, alone = folder_pairs(spark, config) if "folders" in config else (config.get("pairs", [{}]), [])
    for path in alone:
        print(f"no counterpart: {path}", file=sys.stderr)
    for block in blocks:
        block = shared | block
        try:
            result = compare(spark, block)
            summary = result.write(block["out"]) if block.get("out") else result.summary()
            for side in ("left", "right"):
                if block.get("out") and (aside := Source.from_config(block[side]).set_aside(spark)) is not None:
                    write_table(aside, f"{block['out']}/set_aside_{side}")
            done.append({"left": block["left"].get("path"), "right": block["right"].get("path")} | summary)
            print(json.dumps(done[-1]))
        except Exception as e:  # one pair's failure is reported, the others go on
            errors += 1
            print(redacted(f"{type(e).__name__}: {e}".splitlines()[0]), file=sys.stderr)
    if config.get("out") and len(done) > 1:
        roll_up(spark, done, config["out"])
    return exit_code(done, len(alone), errors)


if __name__ == "__main__":
    with open(sys.argv[1]) as f:
        sys.exit(run(build(), json.load(f)))
