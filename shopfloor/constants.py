"""Codes and labels that the ERP data and its reports define."""

from datetime import date

# Operation codes
HEAT_TREAT_OP = "HT-OVOP"
FARMOUT_OPS = ("OMC-OVOP", "OMP-OVOP")
INSPECTION_OP = "9-OP"

# Part transactions
ISSUE_CLASS = "I"
TO_STOCK = "MFG-STK"
TO_CUSTOMER = "MFG-CUS"
TO_VARIANCE = "MFG-VAR"

# Cut-off date of the sales-cost and variance sums
COST_CUTOFF = date(2025, 10, 13)

# Company F001 sees every company but F101; any other sees itself only
GROUP_COMPANY = "F001"
SEPARATE_COMPANY = "F101"

# Status codes and their labels in the report
STATUS_LABELS = {
    1: "1. Material Issued",
    2: "2. Back From HT",
    3: "3. Farmout",
    4: "4. In Process",
    5: "5. OV Not Final",
    6: "6. OV Final or Back",
}
UNKNOWN_LABEL = "0. Unknown"

# Column names of the saved job-status query
SAVED_STATUS_NAMES = {
    "Company": "JobHead6_Company",
    "JobNum": "Calculated_JobNum",
    "Status": "Calculated_Status",
}
# Prefix of the company column where the saved query of a rule set differs
SAVED_COMPANY = {"legacy": "JobHead6_Company", "open_firm": "JobHead8_Company", "head_qty": "JobHead6_Company"}

# Verdict of the comparison
VERDICT_PASS = "QUERIES PRODUCE IDENTICAL RESULTS"
VERDICT_FAIL = "QUERIES HAVE DIFFERENCES - REVIEW REQUIRED"

# Rule sets for the job status
LEGACY = "legacy"
OPEN_FIRM = "open_firm"
HEAD_QTY = "head_qty"  # open_firm, completion by the quantity of the job alone
OPEN_MODES = (OPEN_FIRM, HEAD_QTY)
