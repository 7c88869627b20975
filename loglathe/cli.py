"""Command line: ``python -m loglathe.cli PROGRAM [FILE…] [options]``; reads standard input without files."""

from __future__ import annotations

import argparse
import sys

from loglathe.errors import ProgramError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loglathe", description="Query log lines as time series.")
    p.add_argument("program")
    p.add_argument("files", nargs="*", help="text files or folders")
    p.add_argument("-s", "--since", help="first time that counts")
    p.add_argument("-u", "--until", help="last time that counts")
    p.add_argument("-I", "--interval", help="step between instants, such as 10s")
    p.add_argument("-b", "--lookback", help="how far back an instant looks for a series' latest sample")
    p.add_argument("-i", "--interactive", action="store_true", help="show one instant at a time")
    p.add_argument("-v", "--verbose", action="store_true", help="line numbers and empty instants too")
    p.add_argument("--compat", action="store_true", help="computed results instead of documented ones where they differ")
    return p


def main(argv: list[str] | None = None, stdin=sys.stdin, stdout=sys.stdout, spark=None) -> int:
    a = parser().parse_args(argv)
    from loglathe.engine import rejected, run
    from loglathe.session import session
    from loglathe.sources.lines import from_texts, read_lines

    try:
        spark = spark or session()
        lines = read_lines(spark, a.files[0]) if a.files else from_texts(spark, stdin)
        for path in a.files[1:]:
            lines = lines.unionAll(read_lines(spark, path))
        result = run(a.program, lines, a.since, a.until, a.interval, a.lookback, a.compat)
        for text in result.lines(a.verbose, a.interactive):
            stdout.write(text + "\n")
        if a.verbose:
            for row in rejected(a.program, lines).orderBy("line_no").toLocalIterator():
                print(f"{row.line_no}: skipped: {row.value}", file=sys.stderr)
    except (ProgramError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
