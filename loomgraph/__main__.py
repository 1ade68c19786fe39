"""Runs the command line: python -m loomgraph COMMAND ..."""

from loomgraph.cli import main

raise SystemExit(main())
