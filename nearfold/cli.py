"""Command line: dedup, dedup-copy, dedup-patch, compare, dup-top."""

from __future__ import annotations

import argparse
import os
import shlex
import subprocess
import sys
from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfold.functions.similarity import hash_hex
from nearfold.operators.keep import DEFAULT_KEEP, preferences
from nearfold.plans import apply, dedup
from nearfold.progress import reported
from nearfold.sources.images import list_files, read_images, scan_list
from nearfold.tables import forget, stored

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nearfold", description="Find and resolve near-duplicate images.")
    top.add_argument("--version", action="version", version=VERSION)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, *options: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=about, description=about)
        p.add_argument("--verbose", "-v", action="store_true", help="Show what was found in detail.")
        add = {
            "path": lambda: p.add_argument("--path", "-p", required=True, help="Folder to deduplicate; links are left alone."),
            "source": lambda: p.add_argument("--source", "-s", required=True, help="Folder to read from."),
            "destination": lambda: p.add_argument("--destination", "-d", required=True, help="Folder to write to."),
            "bar": lambda: p.add_argument("--duplicate-similar", "-ds", type=int, default=dedup.DEFAULT_BAR, help="Least similarity of duplicates in per cent, 96 to 100 recommended [96]."),
            "recursive": lambda: p.add_argument("--recursive", "-r", action="store_true", help="Descend into subfolders."),
            "keep": lambda: p.add_argument("--keep", "-k", nargs="+", action="extend", help=f"Which image to keep, first preference first [{' '.join(k.value for k in DEFAULT_KEEP)}]."),
            "action": lambda: p.add_argument("--action", "-a", default=dedup.Action.MOVE_TO_TRASH.value, help=f"One of {', '.join(a.value for a in dedup.Action)} [MoveToTrash]."),
            "yes": lambda: p.add_argument("--yes", "-y", action="store_true", help="Do not wait for confirmation."),
            "extensions": lambda: p.add_argument("--extensions", "-e", nargs="+", action="extend", help=f"Extensions to read [{' '.join(dedup.DEFAULT_EXTENSIONS)}]."),
            "viewer": lambda: p.add_argument("--viewer", help="Command that shows an image before it is asked for."),
            "threads": lambda: p.add_argument("--threads", "-t", type=int, default=os.cpu_count(), help="Threads of a local session [number of CPUs]."),
        }
        for option in options:
            add[option]()
        return p

    common = ("bar", "recursive", "keep", "extensions", "threads")
    verb("dedup", "Resolve duplicates in a folder.", "path", *common, "action", "yes", "viewer")
    verb("dedup-copy", "Copy images that the destination has no duplicate of.", "source", "destination", *common, "yes")
    verb("dedup-patch", "Overwrite destination images with better duplicates.", "source", "destination", *common)
    verb("compare", "Compare images with each other.", "threads").add_argument("--images", "-i", nargs="+", action="extend", required=True, help="Images, two at least.")
    p = verb("dup-top", "Find the images of a folder most similar to one.", "source", "recursive", "extensions", "threads")
    p.add_argument("--input", "-i", required=True, help="Image to search for.")
    p.add_argument("--top", type=int, default=15, help="How many to show [15].")
    return top


def session(threads: int) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    return SparkSession.builder.master(f"local[{threads}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(threads)).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ask(text: str) -> None:
    input(f"{text}\nPress ENTER to go on.")


def viewer(command: str | None):
    """Starts the command with a path; a command that fails is no reason to stop."""

    def show(path: str) -> None:
        try:
            subprocess.Popen([*shlex.split(command), path], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        except OSError as error:
            print(f"nearfold: {path} cannot be shown: {error}", file=sys.stderr)

    return show if command else None


def tell_images(images) -> None:
    for r in images.orderBy("id").select("*", hash_hex(F.col("hash")).alias("hex")).toLocalIterator():
        print(f"{r['physical_path']}: hash {r['hex']}, size {r['size']}, resolution {r['resolution']}, grayscale {r['is_grayscale']}")


def run(args: argparse.Namespace) -> None:
    if args.verb == "compare" and len(args.images) < 2:
        raise ValueError("at least two images are needed")
    keep = preferences(args.keep or DEFAULT_KEEP) if hasattr(args, "keep") else []
    extensions = getattr(args, "extensions", None) or list(dedup.DEFAULT_EXTENSIONS)
    confirm = None if getattr(args, "yes", True) else ask
    bar = getattr(args, "duplicate_similar", 0)
    spark = session(args.threads)

    def scan(folder: str, links: bool, first_id: int = 0):
        paths = list_files(folder, args.recursive, extensions, links)
        if args.verbose:
            print(f"{folder}: {len(paths)} files with one of {', '.join(extensions)}" + (f"; duplicates from {bar}% similarity on." if bar else "."))
        # Hashed once, read by every step of the plan.
        with reported(spark, lambda done: print(f"{done:.0%} read", file=sys.stderr)) if args.verbose else nullcontext():
            images = stored(read_images(spark, paths, first_id), "scan")
        if args.verbose:
            tell_images(images)
        return images, first_id + len(paths)

    if args.verb == "compare":
        images = stored(scan_list(spark, args.images), "scan")
        if images.count() < len(args.images):
            raise ValueError("some of the images cannot be decoded")
        if args.verbose:
            tell_images(images)
        for r in dedup.compare(images).orderBy("id_a", "id_b").toLocalIterator():
            print(f"Similarity of {args.images[r['id_a']]} and {args.images[r['id_b']]}: {r['similarity']:.2%}")
    elif args.verb == "dup-top":
        query = scan_list(spark, [args.input]).select("hash").first()
        if query is None:
            raise ValueError(f"{args.input} cannot be decoded")
        images, _ = scan(args.source, links=False)
        for r in dedup.top_similar(images, query["hash"], args.top).collect():
            print(f"{r['physical_path']}: {r['similarity']:.2%}")
    elif args.verb == "dedup":
        root = os.path.abspath(args.path)
        images, _ = scan(root, links=False)
        plan = stored(dedup.dedup_plan(images, bar, keep, args.action, root), "plan")
        asked = dedup.described(plan, images) if confirm else plan
        found = plan.count()
        print(f"{images.count()} images, {found} duplicates, {apply.apply_dedup(asked, confirm, viewer(args.viewer))} resolved.")
        if found and dedup.action_of(args.action) is dedup.Action.NOTHING:
            print("nearfold: nothing was done to the duplicates; --action says what to do.", file=sys.stderr)
    else:
        source, destination = os.path.abspath(args.source), os.path.abspath(args.destination)
        a, n = scan(source, links=True)
        b, _ = scan(destination, links=False, first_id=n)
        if args.verb == "dedup-copy":
            plan = stored(dedup.copy_plan(a, b, bar, keep, source, destination), "plan")
            copied = apply.apply_copy(plan, confirm)
            r = dedup.copy_summary(plan, a).first()
            print(f"{r['images']} images in {r['groups']} groups: {copied} copied, {r['skipped']} skipped.")
        else:
            grouped = dedup.patch_groups(a, b, bar)
            plan = stored(dedup.patch_plan(a, b, bar, keep, grouped), "plan")
            r = dedup.patch_summary(a, b, grouped, plan).first()
            print(f"{r['images']} images, {r['grouped_images']} of them in {r['groups']} groups: {apply.apply_patch(plan)} images overwritten.")


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well, 1 otherwise."""
    try:
        try:
            run(parser().parse_args(argv))
        finally:
            active = SparkSession.getActiveSession()
            if active:
                forget(active)
    except SystemExit as end:
        return 0 if not end.code else 1
    except (ValueError, OSError) as error:
        print(f"nearfold: {error}", file=sys.stderr)
        return 1
    return 0
