"""Command line of all queries, those of this subpackage included."""

from lodestar.cli import main
from lodestar.llm.catalog import queries

if __name__ == "__main__":
    raise SystemExit(main(more=queries()))
