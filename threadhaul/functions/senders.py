"""Flat sender columns of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sender_columns(sender: Column) -> dict[str, Column]:
    """The five sender columns.

    What decides is which object is present, not which field is filled: a user
    without an id gives NULL and does not fall back to the application.
    """
    user, application = sender["user"], sender["application"]

    def by_presence(user_field: str, application_field: str) -> Column:
        return F.when(user.isNotNull(), user[user_field]).when(
            application.isNotNull(), application[application_field]
        )

    return {
        "fromid": by_presence("id", "id"),
        "fromdisplayname": by_presence("displayName", "displayName"),
        "fromidentitytype": by_presence("userIdentityType", "applicationIdentityType"),
        "fromtenantid": user["tenantId"],
        "fromtype": F.when(user.isNotNull(), "user")
        .when(application.isNotNull(), "application")
        .when(sender["device"].isNotNull(), "device"),
    }
