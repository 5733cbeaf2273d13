"""python -m corpuskit.cli: --version, show-version, serve."""

import argparse

from corpuskit import __version__


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpuskit")
    parser.add_argument("--version", action="store_true")
    parser.add_argument("command", nargs="?", choices=("show-version", "serve"))
    got = parser.parse_args(args)
    if got.version or got.command == "show-version":
        print(f"corpuskit {__version__}")
    elif got.command == "serve":
        print("Serving is not part of this library; queries run in a Spark session.")
    else:
        parser.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
