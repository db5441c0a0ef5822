"""Expressions shared by the operators, as SQL text.

A condition that is NULL counts as not met, except where a rule set says otherwise.
"""

from __future__ import annotations

from shopfloor.constants import (
    FARMOUT_OPS,
    GROUP_COMPANY,
    HEAT_TREAT_OP,
    INSPECTION_OP,
    ISSUE_CLASS,
    LEGACY,
    SEPARATE_COMPANY,
    STATUS_LABELS,
    UNKNOWN_LABEL,
)

# JobHead
OPEN_AND_FIRM = "not JobClosed and JobFirm"
FIRM_NOT_CLEARED = "not WIPCleared and JobFirm"

# JobOper
FARMOUT = f"OpCode in {FARMOUT_OPS}"
OUTSIDE = f"SubContract and not ({FARMOUT})"
HEAT_TREATED = f"OpCode = '{HEAT_TREAT_OP}' and OpComplete"
NOT_INSPECTION = f"OpCode <> '{INSPECTION_OP}'"

# PartTran
ISSUED = f"TranClass = '{ISSUE_CLASS}' and TranQty > 0"

# Highest level first: the flag that decides a level of 6 to 1.
STATUS_FLAGS = {
    6: "OVFinalOrBack",
    5: "OVNotFinal",
    4: "InProcess",
    3: "Farmout",
    2: "BackFromHT",
    1: "MtlIssued",
}

# Material is issued and hours are booked.
NEW_IP = "if(MtlIssued = 1 and TotalLaborHrs > 0, 1, 0)"
IN_PROCESS = "if(NewIP = 1 or NewIP2 = 1, 1, 0)"


def new_ip2(mode: str) -> str:
    """Back from heat treatment without hours; missing hours count as none only under open/firm."""
    hours = "TotalLaborHrs" if mode == LEGACY else "coalesce(TotalLaborHrs, 0)"
    return f"if(BackFromHT = 1 and {hours} = 0, 1, 0)"


def status_code() -> str:
    """The highest level whose flag is set, 0 if none is."""
    levels = [f"if({name} = 1, {level}, null)" for level, name in STATUS_FLAGS.items()]
    return f"coalesce({', '.join(levels)}, 0)"


def status_label(status: str = "Status") -> str:
    labels = [f"if({status} = {code}, '{text}', null)" for code, text in STATUS_LABELS.items()]
    return f"coalesce({', '.join(labels)}, '{UNKNOWN_LABEL}')"


def combined_status(top: str, assembly: str, mode: str) -> str:
    """Status of a job from its top assembly and one unfinished assembly (NULL if there is none).

    The assembly wins when it is behind the top. For a top at 0 without any
    assembly the legacy rules give NULL, the open/firm rules 0.
    """
    alone = "null" if mode == LEGACY else "0"
    return f"if({top} = 0, coalesce({assembly}, {alone}), least({assembly}, {top}))"


def company_visible(company_id: str, company: str = "Company") -> str:
    """Whether a session of ``company_id`` may see the rows of ``company``."""
    if company_id == GROUP_COMPANY:
        return f"{company} <> '{SEPARATE_COMPANY}'"
    escaped = company_id.replace("\\", "\\\\").replace("'", "\\'")
    return f"{company} = '{escaped}'"
