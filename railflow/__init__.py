"""Rail smart-card and Wi-Fi trace analytics as Spark DataFrame operators."""
