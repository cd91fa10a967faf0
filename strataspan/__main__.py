"""Command line: layout IMAGE..., probe IMAGE..., drives [FILE], copy --mode=smart|restore|zeros --from --to [--size] [--block-size]."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from dataclasses import asdict

from strataspan.formats import detect, layout
from strataspan.formats.reader import Bad, File, Short
from strataspan.plans.jobs import parse_size
from strataspan.sources import drives


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strataspan").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _copy(a: argparse.Namespace) -> None:
    from strataspan.operators import copying

    block = parse_size(a.block_size) if a.block_size else 4 << 20
    if block is None or block % 4096 or not 4096 <= block <= 256 << 20:
        raise Bad("the block size must be a multiple of 4096 from 4K to 256M")
    if a.mode != "zeros" and os.path.exists(a.to) and os.path.realpath(a.source) == os.path.realpath(a.to):
        raise Bad("source and target are the same file")
    spark = _session()
    if a.mode == "zeros":
        size = parse_size(a.size or "") or (os.path.getsize(a.to) if os.path.exists(a.to) else 0)
        copying.write_zeros(spark, a.to, size)
        print(json.dumps({"zeros": size}))
    elif a.mode == "restore":
        print(json.dumps({"restored": copying.restore(spark, a.source, a.to)}))
    elif os.path.exists(a.to) and not a.to.endswith(".zst"):
        print(json.dumps({"copied": copying.copy_used(spark, a.source, a.to)}))
    else:
        shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="strataspan-")
        print(json.dumps(copying.backup(spark, a.source, a.to, shared)))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataspan", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("layout", "probe"):
        s = sub.add_parser(name)
        s.add_argument("images", nargs="+")
        s.add_argument("--estimate", action="store_true", help="believe file systems that aren't clean")
    s = sub.add_parser("drives")
    s.add_argument("listing", nargs="?", help="a file with lsblk's JSON; else lsblk runs")
    s = sub.add_parser("copy")
    s.add_argument("--mode", choices=["smart", "restore", "zeros"], default="smart")
    s.add_argument("--from", dest="source", default="")
    s.add_argument("--to", required=True)
    s.add_argument("--size")
    s.add_argument("--block-size")
    a = p.parse_args(args)
    try:
        if a.what == "layout":
            for path in a.images:
                print(json.dumps({"image": path, **layout.analyze(File(path), "estimate" if a.estimate else "copy").json()}))
        elif a.what == "probe":
            for path in a.images:
                print(json.dumps({"image": path, **asdict(detect.probe(File(path)))}))
        elif a.what == "drives":
            columns = "NAME,PATH,SIZE,TYPE,TRAN,RM,HOTPLUG,RO,ROTA,MODEL,VENDOR,LABEL,PARTLABEL,FSTYPE,MOUNTPOINTS"
            text = open(a.listing).read() if a.listing else drives.run_tool(["lsblk", "-J", "-b", "-o", columns], 20)
            print(json.dumps([asdict(d) for d in drives.parse_lsblk(text)], indent=2))
        else:
            _copy(a)
    except (Bad, Short, OSError, ValueError) as e:
        print(f"strataspan: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
