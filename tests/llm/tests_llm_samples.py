"""A few labelled texts for the language dictionaries of the tests."""

SAMPLES = [
    ("en", "The rain will stop before morning. We don't have enough money for the ferry. She said that they would not come. It is not the first time that you have been there. I'm sorry, I can't go with you."),
    ("de", "Der Regen wird vor dem Morgen aufhören. Wir haben nicht genug Geld für die Fähre. Sie sagte, dass sie nicht kommen würden. Es ist nicht das erste Mal."),
    ("es", "La lluvia parará antes de la mañana. No tenemos dinero suficiente para el ferri. Ella dijo que no vendrían. No es la primera vez."),
    ("vi", "Mưa sẽ tạnh trước khi trời sáng. Chúng ta không đủ tiền đi phà. Cô ấy nói rằng họ sẽ không đến. Đây không phải lần đầu tiên."),
    ("fr", "La pluie va s'arrêter avant le matin. Nous n'avons pas assez d'argent pour le bac. Elle a dit qu'ils ne viendraient pas. Ce n'est pas la première fois."),
]
