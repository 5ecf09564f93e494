"""Accounts, requests, departments and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The departments an account may have, and the places of a small directory.
DEPARTMENTS = ("妇产科", "内科", "皮肤性病科", "儿科", "眼耳鼻喉科", "肿瘤科", "神经科学", "外科", "男性健康科", "感染与免疫科", "口腔科", "心理科学", "中医科", "生殖健康科", "急诊科", "其他")
DIRECTORY = (("耳鼻喉科", 12, 8, "周一至周六 8:00-17:00"), ("内科", 20, 15, "每日 8:00-17:00"), ("儿科", 9, 3, "每日 8:00-20:00"), ("皮肤科", 7, 0, "周一至周五 8:00-17:00"))
SECRET = ("salt", "password_hash")


def phone_ok(phone: Column) -> Column:
    """Eleven digits that begin with 1 and 3 to 9; one line end after them is let through. Null isn't a phone."""
    return F.coalesce(phone.rlike("(?U)^1[3-9]\\d{9}\\n?\\z"), F.lit(False))


def account_status(requests: DataFrame, accounts: DataFrame, departments: tuple[str, ...] = DEPARTMENTS) -> DataFrame:
    """The requests (phone, name, department, password) with status: the first rule that a request breaks, or ok."""
    known = accounts.select(F.col("phone").alias("known")).distinct()
    status = (
        F.when(~phone_ok(F.col("phone")), "phone").when(T.strip(F.coalesce("name", F.lit(""))) == "", "name")
        .when(~F.coalesce(F.col("department").isin(*departments), F.lit(False)), "department").when(F.col("known").isNotNull(), "exists")
        .when(F.length(F.coalesce("password", F.lit(""))) < 6, "password").otherwise("ok")
    )
    return requests.join(known, F.col("phone") == F.col("known"), "left").withColumn("status", status).drop("known")


def hashed(password: Column, salt: Column) -> Column:
    """A salted digest; the clear text is never kept."""
    return F.sha2(F.concat(salt, password).cast("binary"), 256)


def public_profiles(accounts: DataFrame) -> DataFrame:
    return accounts.drop(*SECRET)


def account_list(accounts: DataFrame) -> DataFrame:
    """Public profiles with their place: administrators first, then by department (none counts as 管理) and phone, by code point."""
    order = (F.when(F.col("is_admin"), 0).otherwise(1), F.when(F.coalesce("department", F.lit("")) == "", "管理").otherwise(F.col("department")), "phone")
    return public_profiles(accounts).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def directory(spark) -> DataFrame:
    return spark.createDataFrame(list(DIRECTORY), "name string, doctors int, slots int, hours string")


def lookup(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """name, department, registration: texts on the queries' (name) departments, by exact name. ``rows`` is a small directory."""
    missing = F.concat(F.lit("未找到科室「"), "name", F.lit("」"))
    n = F.col("slots").cast("string")
    about = F.concat(F.lit("科室「"), "name", F.lit("」：医生 "), F.col("doctors").cast("string"), F.lit(" 人，剩余号源 "), n, F.lit("，"), "hours")
    left = F.concat(F.lit("「"), "name", F.lit("」当前剩余号源 "), n)
    free = F.when(F.col("slots") > 5, F.concat(left, F.lit(" 个（号源充足，可预约）"))).when(F.col("slots") > 0, F.concat(left, F.lit(" 个（号源紧张，建议尽快）"))).otherwise(F.concat(F.lit("「"), "name", F.lit("」今日号源已满")))
    here = F.col("doctors").isNotNull()
    return queries.join(rows, "name", "left").select("name", F.when(here, about).otherwise(missing).alias("department"), F.when(here, free).otherwise(missing).alias("registration"))


def thread_id(user: Column, conversation: Column) -> Column:
    return F.concat(user, F.lit("@@"), conversation)


def thread_user(thread: Column) -> Column:
    return F.substring_index(thread, "@@", 1)


def thread_conversation(thread: Column) -> Column:
    """All that follows the first separator."""
    return F.substring(thread, F.instr(thread, "@@") + 2, F.length(thread))


def queue_label(department: Column, risk: Column, user: Column) -> Column:
    return F.concat(F.lit("["), department, F.lit("] "), risk, F.lit(" · 用户 "), F.left(user, F.lit(8)))


def conversation_titles(messages: DataFrame, most: int = 20) -> DataFrame:
    """conv_id, title: the beginning of each conversation's first message."""
    return messages.groupBy("conv_id").agg(F.left(F.min_by("text", "turn"), F.lit(most)).alias("title"))


def conversation_list(conversations: DataFrame) -> DataFrame:
    """conv_id, label of (conv_id, title, created); equal labels stay apart by conv_id."""
    return conversations.select("conv_id", F.concat_ws(" - ", "title", "created").alias("label"))
