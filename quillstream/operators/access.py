"""Access gates (FLT1 to FLT5, JN1 to JN3). Defaults for a missing settings row differ by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_settings(users: DataFrame, settings: DataFrame) -> DataFrame:
    """users with publicEnabled and authorizedMusicStats, null where there is no settings row."""
    return users.join(settings.select(F.col("user_id").alias("id"), "publicEnabled", "authorizedMusicStats"), "id", "left")


def by_key(requests: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """Each request (request_id, key) with its user, if any; keys are unique."""
    return requests.join(users.withColumnRenamed(column, "key"), "key", "left")


def secret_code(key: Column, user_id: Column, status: Column) -> Column:
    """0, 401 for a missing or unknown key, 403 for a disabled user."""
    return F.when((key == "") | key.isNull() | user_id.isNull(), 401).when(status != 1, 403).otherwise(0)


def sharing_code(key: Column, user_id: Column, status: Column, public: Column) -> Column:
    """0, 400 without a key, 404 for an unknown one, 403 for a disabled or not public user.

    Here a user without settings is not public.
    """
    return F.when((key == "") | key.isNull(), 400).when(user_id.isNull(), 404).when((status != 1) | ~F.coalesce(public, F.lit(False)), 403).otherwise(0)


def is_public(public: Column) -> Column:
    """On the rendering path a user without settings is public."""
    return F.coalesce(public, F.lit(True))


def may_count(authorized: Column) -> Column:
    return F.coalesce(authorized, F.lit(False))


def socket_code(key: Column, user_id: Column, status: Column, public: Column) -> Column:
    """struct(error_code, message, retryable) of a refused connection; null if it is accepted."""
    refuse = lambda code, text: F.struct(F.lit(code).alias("error_code"), F.lit(text).alias("message"), F.lit(False).alias("retryable"))
    return (
        F.when((key == "") | key.isNull(), refuse("INVALID_REQUEST", "Missing sharingKey parameter"))
        .when(user_id.isNull(), refuse("UNAUTHORIZED", "Sharing key not found"))
        .when(status != 1, refuse("UNAUTHORIZED", "User account is disabled"))
        .when(~F.coalesce(public, F.lit(False)), refuse("UNAUTHORIZED", "Public access is disabled"))
    )


def authorized(history: DataFrame, settings: DataFrame) -> DataFrame:
    """History of users who let their statistics be counted."""
    return history.join(settings.where(may_count(F.col("authorizedMusicStats"))).select("user_id"), "user_id", "left_semi")


def envelope(code: Column, message: Column) -> Column:
    """The base of an answer: success where there is none."""
    return F.struct(F.coalesce(code, F.lit(0)).alias("code"), F.when(code.isNull(), "success").otherwise(message).alias("message"))


def http_status(code: Column) -> Column:
    """Errors that the base of the answer tells travel with HTTP 200."""
    return F.when(code.isin(400, 401, 404, 500), 200).otherwise(code)
