"""Register the models as temporary views, for users who query them with Spark SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ledgerline.plans.mart import Models, build_models, lifecycle_mart
from ledgerline.rules import Rules
from ledgerline.sources.files import Sources


def model_frames(m: Models, as_of: dt.date | str, rules: Rules = Rules(), mart: DataFrame | None = None):
    """Staging, intermediate and mart models by their model names, in layer order."""
    return {
        "stg_billing_accounts": m.staged.billing_accounts,
        "stg_app_accounts": m.staged.app_accounts,
        "stg_app_users": m.staged.app_users,
        "stg_usage_daily": m.staged.usage_daily,
        "stg_arr_daily": m.staged.arr_daily,
        "int_account_bridge": m.bridge,
        "int_arr_monthly": m.arr_monthly,
        "int_usage_monthly": m.usage_monthly,
        "int_user_adoption_monthly": m.adoption_monthly,
        "mart_account_lifecycle_monthly": mart if mart is not None else lifecycle_mart(m, as_of, rules),
    }


def register_views(src: Sources, as_of: dt.date | str, rules: Rules = Rules(), mart: DataFrame | None = None) -> list[str]:
    """``createOrReplaceTempView`` for every model; returns the view names. Views are
    lazy plans: nothing runs until a query reads them."""
    frames = model_frames(build_models(src), as_of, rules, mart)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
