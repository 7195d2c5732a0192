"""Registry tables: employers, employees, vehicles, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.functions import constants as C

SECRET = ("password_hash", "password_salt", "token", "salt")


def registry_listing(table: DataFrame, owner_col: str, owners: DataFrame, order_col: str = "created_at") -> DataFrame:
    """Rows of the owners, newest first, without secret columns."""
    shown = [c for c in table.columns if c not in SECRET]
    return table.join(owners.select(owner_col).distinct(), owner_col, "left_semi").select(*shown).orderBy(F.desc(order_col))


def active_sessions(sessions: DataFrame, subjects: DataFrame, now: int) -> DataFrame:
    """session_id, status: active, expired, or rejected (the subject is missing or not active). sessions: session_id, subject_type, subject_id, expires_at; subjects: subject_type, subject_id, active."""
    there = subjects.groupBy("subject_type", "subject_id").agg(F.max("active").alias("active"))
    j = sessions.join(there, ["subject_type", "subject_id"], "left")
    status = F.when(F.col("expires_at") <= now, "expired").when(F.coalesce("active", F.lit(False)), "active").otherwise("rejected")
    return j.select("session_id", status.alias("status"))


def registry_integrity(employees: DataFrame, employers: DataFrame, vehicles: DataFrame) -> DataFrame:
    """table, rule, key of rows that break a rule: repeated emails, unknown employers or employees, unknown vehicle types."""
    say = lambda df, t, r, k: df.select(F.lit(t).alias("table"), F.lit(r).alias("rule"), F.col(k).cast("string").alias("key"))
    repeated = employees.groupBy("email").count().where("count > 1")
    lost = employees.join(employers.select("employer_id"), "employer_id", "left_anti")
    driverless = vehicles.join(employees.select("employee_id"), "employee_id", "left_anti")
    odd = vehicles.where(~F.coalesce(F.col("vehicle_type").isin(*C.VEHICLE_TYPES), F.lit(False)))
    return say(repeated, "employees", "unique email", "email").unionByName(say(lost, "employees", "employer exists", "employee_id")).unionByName(say(driverless, "vehicles", "employee exists", "vehicle_id")).unionByName(say(odd, "vehicles", "known type", "vehicle_id"))
