"""``python -m chronofold.cli COMMAND --config FILE``: the steps from raw logs to a replayed system."""

from __future__ import annotations

import argparse
from pathlib import Path

COMMANDS = {
    "prepare-data": "raw logs to interactions and items",
    "fit-baselines": "popularity for each half-life, item-item cosine",
    "build-sequences": "strict-prior examples of training and validation",
    "train-retriever": "the two-tower model",
    "evaluate-baselines": "recall of the baselines on validation",
    "evaluate-candidate-union": "recall of each source and of the union",
    "generate-ranker-data": "cross-fitted candidate rows of three folds",
    "train-ranker": "choose and refit the ranker",
    "evaluate": "frozen replay over the test period",
    "benchmark": "time the serving stages",
    "recommend": "the next products for one user",
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronofold", description="Time-safe product discovery.")
    sub = out.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("--config", default="config/base.yaml")
        p.add_argument("--root", default=".")
        if name == "train-retriever":
            p.add_argument("--output-name", default="retriever")
            p.add_argument("--history-only", action="store_true", help="no user embeddings: the prior items alone")
        if name == "evaluate-candidate-union":
            p.add_argument("--retriever-artifact", default="retriever-history-only")
        if name == "recommend":
            p.add_argument("--user-id", required=True)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not Path(args.config).exists():
        raise FileNotFoundError(args.config)
    from chronofold.config import load_config
    from chronofold.plans import commands
    from chronofold.session import build_session

    project = commands.Project(build_session(), args.root, load_config(args.config))
    more = {}
    if args.command == "train-retriever":
        more |= {"output": args.output_name, "history_only": args.history_only}
    if args.command == "evaluate-candidate-union":
        more["retriever"] = args.retriever_artifact
    if args.command == "recommend":
        more["user_id"] = args.user_id
    print(commands.told(getattr(commands, args.command.replace("-", "_"))(project, **more)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
