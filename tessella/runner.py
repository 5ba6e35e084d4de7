"""Numbered steps as processes of their own: python -m tessella.runner STEPS.json [--dry-run] [--from N] [--to N] [--log FILE].

STEPS.json is a list of {"name", "command"}; a command is a list of words. The run stops
at the first step that fails and ends with its code.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time
from collections.abc import Callable

from tessella.sources import shared


def both(path: str) -> Callable[[str], None]:
    """A function that prints a line and appends it, with the time, to a file."""
    def say(line: str) -> None:
        print(line, flush=True)
        with open(path, "a", encoding="utf-8") as file:
            file.write(f"{time.strftime('%Y-%m-%dT%H:%M:%S')} {line}\n")

    return say


def run_steps(steps: list[dict], first: int = 1, last: int | None = None, dry_run: bool = False, say: Callable[[str], None] = print) -> int:
    """Run the steps from `first` to `last`, counted from 1; the code of the one that failed, or 0."""
    for number, step in enumerate(steps, 1):
        if not first <= number <= (last or len(steps)):
            continue
        say(f"{number}/{len(steps)} {step['name']}: {' '.join(step['command'])}")
        if dry_run:
            continue
        began = time.monotonic()
        code = subprocess.run([sys.executable if word == "python" else word for word in step["command"]], check=False).returncode
        say(f"{step['name']}: {'done' if code == 0 else f'failed with {code}'} after {time.monotonic() - began:.1f} s")
        if code:
            return code
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tessella.runner")
    top.add_argument("steps")
    top.add_argument("--dry-run", action="store_true")
    top.add_argument("--from", type=int, default=1, dest="first")
    top.add_argument("--to", type=int, dest="last")
    top.add_argument("--log")
    args = top.parse_args(argv)
    steps = json.loads(shared.content(args.steps))
    return run_steps(steps, args.first, args.last, args.dry_run, both(args.log) if args.log else print)


if __name__ == "__main__":
    sys.exit(main())
