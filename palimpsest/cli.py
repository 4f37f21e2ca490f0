"""Command line: ``python -m palimpsest.cli [options] [query]``."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, field

from palimpsest.engine import Engine
from palimpsest.operators.check import report
from palimpsest.plans.boolean import result_lines
from palimpsest.session import local_session
from palimpsest.sources.config import ConfigError, load

HELP = """Index text files and search them.

  -i, --index      index the configured directory
  -s, --search     search interactively (q, quit or exit ends it)
  --check          check the index (-v, --verbose: every constraint)
  -a, --all        with --index: all files, changed or not
  -c, --current    scan the current directory, all files
  -h, --help       this text

  --config_file=PATH   another settings file
  --KEY=VALUE          overrides a setting

Anything else is a query: words, "exact words", AND, OR, NOT, parentheses.
"""
LEVELS = {1: logging.DEBUG, 2: logging.INFO, 3: logging.WARNING, 4: logging.ERROR}


@dataclass
class Arguments:
    options: list[str] = field(default_factory=list)
    settings: dict[str, str] = field(default_factory=dict)
    query: str = ""

    def any(self, *names: str) -> bool:
        return any(n in self.options for n in names)


def parse_arguments(argv: list[str]) -> Arguments:
    """Options and settings up to the first word without a dash; the rest is the query."""
    out = Arguments()
    for i, arg in enumerate(argv):
        if not arg.startswith("-"):
            out.query = " ".join(argv[i:])
            break
        name = arg[2:] if arg.startswith("--") and len(arg) > 2 else arg[1:]
        if arg.startswith("--") and "=" in name:
            key, _, value = name.partition("=")
            out.settings.setdefault(key, value) if key == "config_file" else out.settings.update({key: value})
        else:
            out.options.append(name)
    return out


def show(engine: Engine, text: str, write) -> None:
    """Writes every hit as it comes; `write` ends the line itself."""
    for line in result_lines(engine.search(text)):
        write(line.removesuffix("\n"))


def log_to(stream, level: int) -> None:
    """Messages of the engine from `level` on, one line each; what a former call set up is replaced."""
    log = logging.getLogger("palimpsest")
    handler = logging.StreamHandler(stream)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(level)


def main(argv: list[str] | None = None, spark=None, read=input, write=print) -> int:
    args = parse_arguments(sys.argv[1:] if argv is None else argv)
    if args.any("h", "help") or not (args.options or args.settings or args.query):
        write(HELP)
        return 0
    home = os.environ.get("HOME")
    file = args.settings.get("config_file") or (f"{home}/.config/palimpsest/config.txt" if home else None)
    settings = dict(args.settings)
    if args.any("a", "all", "c", "current", "current-dir"):
        settings["config_updated_files_only"] = "false"
    if args.any("c", "current", "current-dir"):
        settings["config_path_to_scan"] = os.getcwd()
    try:
        config = load(settings, file)
    except ConfigError as e:
        write(f"Invalid settings: {e}")
        return 1
    log_to(sys.stderr, LEVELS[config.log_level])
    acts = [o for o in args.options if o in ("check", "i", "index", "s", "search")]
    if not acts and not args.query:
        write(HELP)
        return 0
    engine = Engine(spark or local_session("*"), config)
    for act in acts:
        if act == "check":
            checks = engine.check()
            if args.any("v", "verbose"):
                for r in checks.orderBy("check").collect():
                    write(f"{'ok ' if r['ok'] else 'BAD'} {r['check']}: {r['violations']}")
            write(report(checks))
        elif act in ("i", "index"):
            made = engine.index()
            write(f"Indexed: version {made['version']}, {made['n_paths']} paths.")
        else:
            while (text := read("Query (q ends): ")) not in ("q", "quit", "exit"):
                show(engine, text, write)
    if args.query:
        show(engine, args.query, write)
    return 0


if __name__ == "__main__":
    sys.exit(main())
