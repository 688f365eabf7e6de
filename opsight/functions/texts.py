"""Report texts the monitored scripts print.

Users compare these sentences with what they have always seen, so they must
equal the scripts' output character for character.  They are stated once,
here, in the order the checks appear; the operators only assemble them.
"""

# Process dates and stream lag (L1, L5, L6, L7).
UP_TO_DATE = "UP TO DATE"
DAY_S_BEHIND = " DAY/S BEHIND"
DAY_BEHIND = " DAY BEHIND"
DAYS_BEHIND = " DAYS BEHIND"
STREAM_IS_ON = " stream is on "
AND_IS_CURRENTLY = " and is currently "
STREAM_DAY_S_BEHIND = " DAY/S BEHIND."
STREAM_UP_TO_DATE = "UP TO DATE."
NO_DATA_IN_TABLE = "NO DATA IN TABLE."
DASH_NO_DATA_IN_TABLE = " - NO DATA IN TABLE."

# Batch-control workflow status (L8).
WORKFLOW_FAILED_ON = "WORKFLOW FAILED ON "
AND_NOT_UP_TO_DATE = " AND NOT UP TO DATE!"
FAILED_BUT_UP_TO_DATE = "WORKFLOW FAILED BUT UP TO DATE!"
WORKFLOW_NOT_UP_TO_DATE = "WORKFLOW NOT UP TO DATE!"

# Job control parameters (L9); {today} and {tomorrow} are yyyyMMdd.
PARAMETERS_CORRECT = "WORKFLOW UP TO DATE AND PARAMETERS ARE CORRECT!"
PARAMETERS_WRONG = ("WORKFLOW NOT UP TO DATE OR INCORRECT PARAMETERS! MIN_DATE_TS SHOULD BE = {today} and "
                    "MAX_DATE_TS SHOULD BE = {tomorrow}. WORKFLOW SHOULD BE RUN UNTIL THIS CHECK STATUS SAYS "
                    "UP TO DATE, OR PARAMETERS NEEDS TO BE RECTIFIED.")

# Failed-run alert (R2): "Has <n> Failed runs in rt runs ".
HAS = "Has "
FAILED_RUNS_IN_RT_RUNS = " Failed runs in rt runs "

# Run board day row (R7, R9).
DAY_DURATION = "DAY DURATION"

# Tablespace alert (C1).
ADD_A_DATAFILE = "ALERT!!! ADD A DATAFILE!!!"
ENOUGH_SPACE = "ENOUGH SPACE AVAILABLE IN TS"

# Unusable index objects (C7).
INVALID_INDEXED_PARTITION = "INVALID INDEXED PARTITION"
INVALID_INDEXED_SUBPARTITION = "INVALID INDEXED SUBPARTITION"
INDEX_SUFFIX = " INDEX"

# Blocking sessions (G4).
IS_BLOCKING = " is blocking "

# Process-date advancement log (D5).
ADVANCEMENT_PROCESS = "IT Auto-Advancement"
ADVANCED_TO = " process date advanced to "
IS_DAY_MINUS_1 = "Process Date is DAY-1."
NOT_ADVANCED = "Date NOT advanced due to previous days summaries {gate} not loading any rows."

# Pass-through of group-task runs (D10): " Ended: <task> <n> updates."
GROUP_RUN_PROCESS = "DW_TG_MAN_RUN"
GROUP_RUN_ENDED = " Ended: "
GROUP_RUN_UPDATES = " updates."
