"""The monitored scripts' own filter patterns, used as operator defaults.

A site passes its own patterns; the defaults select what the scripts select,
so a switching user gets the same rows without changing a call.
"""

GROUP_TASKS = "%TG%"                      # group tasks (L3 second branch, D10)
GROUP_TEMPLATE = "%STD_GROUP_TASK"        # template of a group task's step (D10)
WAIT_TASKS = "%WAIT%"                     # wait tasks left out of L3
RULE_TASKS = "%RULE%"                     # rule tasks left out of R5
S2C_TASKS = "%S2C%"                       # rollup tasks (R10-R12)
PATTERN_TASKS = "%PATTERN%"               # pattern tasks left out of the rollups
FILE_LOADER_TASKS = "TF%"                 # file loaders (T1)
CALENDAR_TASKS = "TF_S2S_%"               # file tasks of the daily file calendar (F3)
EMPTY_BATCH_TASKS = "TG_CDR%"             # tasks checked for empty audited batches (B3)
STAGING_TABLES = "STG_CDR.%"              # staging targets dated by batch key (L5)
LOAD_DATE_TABLES = ("%SGSN%", "%MSC%")    # targets dated by load start (L5)
FACT_TABLES = "%FCT%"                     # fact targets of the area lag (L6)
SALES_FACT_TABLES = "%FCT%SALE%"          # sales facts left out of L6
EXCLUDED_AREAS = ("Internal", "Monitoring")   # business areas left out of L6
EXCLUDED_TASK_PREFIXES = ("X%",)          # task names left out of L6
WEEKLY_STREAMS = "%SUMW"                  # weekly streams: two days of grace (L6)
SAME_DAY_STREAMS = "%EWP%"                # same-day streams: no grace (L6)
DDL_OBJECTS = "%DDL%"                     # objects of the lock-mode listing (G6)
STAGING_SPACE = "TS_STG_GEN"              # space of the batch partitions (C10)
