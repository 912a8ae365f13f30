"""kpivane: KPIs, features, signals and explanations as Spark DataFrame plans."""
