"""A chain of stages for several objectives: stages are isolated, a gate ends its own objective only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from tidemark.sources.tables import write_json

#: The statuses of a stage that leave something to use.
USABLE = ("completed", "cut_short", "already_complete")


class GateFailed(Exception):
    """A gate did not pass; its objective's later stages are skipped."""


@dataclass
class Stage:
    name: str
    run: Callable[[str, object], tuple[str, object]]
    #: Whether what this stage makes is one of the objective's results.
    variant: bool = True


@dataclass
class Manifest:
    path: str | None = None
    stages: list[dict] = field(default_factory=list)
    objectives: dict[str, str] = field(default_factory=dict)
    outcome: str | None = None

    def write(self) -> None:
        if self.path:
            write_json({"stages": self.stages, "objectives": self.objectives, "outcome": self.outcome}, self.path)


def run_chain(objectives: Sequence[str], stages: Sequence[Stage], path: str | None = None) -> Manifest:
    """Runs the stages of each objective in order; each gets what the last usable one made.

    A stage returns (status, product) with a usable status. One that raises is failed and its successors are skipped;
    GateFailed aborts the objective. The outcome is completed if every variant was made and none cut short, partial if
    some were made, aborted_at_gate if every objective was aborted, else failed.
    """
    out = Manifest(path)
    for objective in objectives:
        product, ended = None, None
        for stage in stages:
            record = {"objective": objective, "stage": stage.name, "variant": stage.variant}
            began = time.time()
            if ended:
                record["status"] = "skipped"
            else:
                try:
                    record["status"], product = stage.run(objective, product)
                    if record["status"] not in USABLE:
                        raise ValueError(f"unknown status {record['status']}")
                except GateFailed as e:
                    record |= {"status": "failed", "error": str(e)}
                    ended = "aborted_at_gate"
                except Exception as e:  # noqa: BLE001 - one objective's failure is recorded and must not stop the others
                    record |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
                    ended = "failed"
            record["seconds"] = round(time.time() - began, 3)
            out.stages.append(record)
            out.write()
        out.objectives[objective] = ended or _objective([s["status"] for s in out.stages if s["objective"] == objective])
    made = [s for s in out.stages if s["variant"] and s["status"] in USABLE]
    wanted = len(objectives) * sum(s.variant for s in stages)
    if len(made) == wanted and all(s["status"] != "cut_short" for s in made):
        out.outcome = "completed"
    elif made:
        out.outcome = "partial"
    elif out.objectives and all(o == "aborted_at_gate" for o in out.objectives.values()):
        out.outcome = "aborted_at_gate"
    else:
        out.outcome = "failed"
    out.write()
    return out


def _objective(statuses: list[str]) -> str:
    return "partial" if "cut_short" in statuses else "completed"
