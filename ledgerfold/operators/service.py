"""The public calls: commands in, events and replies out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.codecs import redact_secret, with_default_id
from ledgerfold.operators import admission, gate
from ledgerfold.operators.replies import replies
from ledgerfold.session import stored


def handle(commands: DataFrame, entity: str = "user", surface: str = "grpc", departments: DataFrame | None = None,
           carried: DataFrame | None = None, salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, replies) of a command log at one surface: callers and fields are checked
    first, admitted commands pass the entity's gate, secrets are digested before an
    event holds them."""
    if entity == "user":
        commands = with_default_id(commands, always_username=surface == "grpc")
    checked = admission.admit(commands, entity, surface)
    passing = admission.admitted(checked)
    if entity == "user":
        if salt is not None:
            passing = passing.withColumn("pass", redact_secret(F.col("pass"), F.lit(salt)))
        decided, spec = gate.user_gate(passing, departments, carried), gate.USER_GATE
    else:
        decided, spec = gate.department_gate(passing, carried), gate.DEPARTMENT_GATE
    # Written once: events and replies are both read from it.
    decided = stored(decided, "decisions")
    answers = replies(decided, entity, surface).unionByName(replies(admission.rejected(checked), entity, surface))
    return gate.events(decided, spec), answers
